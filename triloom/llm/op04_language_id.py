"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams over all learning documents. A
document is ranked the same way and compared by out-of-place distance: the sum, over its n-grams, of
how far the rank is from the language's, at most the profile's length for those it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, prepare, unused
from triloom.llm.memory import release, trimmed

#: n-grams of a profile, and the lengths counted.
TOP, LENGTHS = 400, (1, 2, 3)
_SEGMENT = 1 << 20
#: Distinct n-grams a learning task holds before it passes its counts on.
_HELD = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes ascending, counts) of a whole text: lower-cased letters, one blank for whatever
    lies between words. A code packs up to three code points in 21 bits each."""
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    low = (text or "").lower()
    for at in range(0, len(low), _SEGMENT):
        begin, end = max(0, at - 2), at + _SEGMENT  # the two characters before give the context
        c, n = _segment(low[begin:end], at - begin, begin == 0, end >= len(low))
        codes, counts = (c, n) if not len(codes) else _merged(np.concatenate([codes, c]), np.concatenate([counts, n]))
    return codes, counts


def _segment(text: str, seen: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts the n-grams that end behind the first `seen` characters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[raw]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # a blank stands for a run of other characters
    point = np.where(letter, raw, 32).astype(np.uint64)[keep]
    fresh = (np.arange(len(raw)) >= seen)[keep]
    if first and point[0] != 32:
        point, fresh = np.concatenate([[np.uint64(32)], point]), np.concatenate([[False], fresh])
    if last and point[-1] != 32:
        point, fresh = np.append(point, np.uint64(32)), np.append(fresh, True)
    two = (point[:-1] << np.uint64(21)) | point[1:]
    three = (two[:-1] << np.uint64(21)) | point[2:]
    middle = point[1:-1] != 32  # no n-gram of two words, none of blanks alone
    return np.unique(np.concatenate([point[fresh & (point != 32)], two[fresh[1:]], three[fresh[2:] & middle]]), return_counts=True)


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] ^ np.uint64(1)))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order, ties by code."""
    if len(codes) > top:
        keep = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): what each task counted, to be summed; over whole texts of rows (text, lang)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = _merged(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view("i8")), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = held.setdefault(lang, [])
                parts.append(grams(text))
                if len(parts) >= 64:
                    parts[:] = [_merged(*map(np.concatenate, zip(*parts, strict=True)))]
            if sum(len(c) for parts in held.values() for c, _ in parts) > _HELD:
                yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(trimmed(run), "lang string, gram long, n long")


def learn(docs: DataFrame, top: int = TOP, scratch: Scratch | None = None) -> dict[str, list[int]]:
    """Profiles by language from all rows with text and lang: n-grams in order of count, ties by code.
    The driver gets `top` numbers for each language."""
    scratch = scratch or Scratch(docs.sparkSession)
    total = gram_counts(docs.where("text is not null and lang is not null")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = scratch.cut(total, "grams")
    # The count of the top-th n-gram bounds what is ranked; an alphabet's n-grams are few beside the texts.
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    """Distances of texts to all profiles: one lookup of a document's n-grams in the sorted union."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            p = np.array(profiles[name], np.int64).view(np.uint64)
            self.ranks[i, np.searchsorted(self.codes, p)] = np.arange(len(p))

    def identify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the least distance, ties to the lesser name. The score is how far the
        document is from sharing nothing with the language, in (0, 1]; 0 with `und`."""
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        own = _ranked(codes, counts, self.top)
        at = np.minimum(np.searchsorted(self.codes, own), max(0, len(self.codes) - 1))
        known = self.codes[at] == own
        rank = self.ranks[:, np.where(known, at, len(self.codes))]
        off = np.where(rank >= 0, np.minimum(np.abs(rank - np.arange(len(own))), self.top), self.top).sum(axis=1)
        best = int(off.argmin())
        return self.names[best], float(1 - off[best] / (self.top * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to all rows and columns of docs; only the text is looked at.

    Null and empty texts, and those without a letter, are `und` with score 0, as is everything if
    there are no profiles. The profiles travel with the tasks: languages times `top` numbers.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])

    @F.pandas_udf("lang_pred string, score double")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(profiles, top)
        for t in texts:
            yield pd.DataFrame([model.identify(x) for x in t], columns=["lang_pred", "score"])
        release()

    (told,) = unused(docs.columns, "_told")
    return docs.withColumn(told, call(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns], f"{told}.lang_pred", f"{told}.score")


def held_out(ident: Column) -> Column:
    """True for the rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_of_documents(docs: DataFrame, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the rows that are not held out.

    A null doc_id is not held out. Repeated rows count and are returned each by itself. An empty
    table gives no rows; other columns than text, lang and doc_id are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    profiles = learn(rows.where(~F.col("held_out")), top, scratch)
    return identify(rows.select("doc_id", "held_out", "text"), profiles, top).select("doc_id", "held_out", "lang_pred", "score")
