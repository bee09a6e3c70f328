"""Collocations by position bitmaps: words that stand together much more often than their parts would.

The words of a language are dealt into shards. In a shard each word has a bitmap of its positions, kept
as its non-zero blocks of 16 bits. A phrase's bitmap marks where it ends: shifted by one and cut (AND) with
that of a word it becomes the bitmap of the longer phrase, and its set bits are the phrase's count. Ends
of pieces take a position that no word has, so no phrase crosses them. Counts of shards add up: first of words,
then of pairs of words that may be frequent, then of three words whose pairs may be, these two by hash.
Phrases are extended while every three of their words may be frequent together, from one batch of pairs
down to the longest phrase before the next batch; only what is left becomes strings. Shards stay where they
are; what may be frequent comes to them as hashed places of a bitmap of bounded size. It lets too much through
(more where it fills up) but loses nothing, and what counts in the end are the sums of exact strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import A_Z, Scratch, a_z, prepare, ranked
from triloom.llm.memory import trimmed
from triloom.llm.shingles import mix

LONGEST, LEAST, TOP = 5, 100, 2000
#: Positions of a shard (and up to a segment more), characters of a segment, pairs or entries of a batch.
SHARD, SEGMENT, BATCH = 1 << 18, 1 << 19, 1 << 16
#: Bits of a block of a bitmap; places of a bitmap of what may be frequent: 16 for each, 16 MB in all at most.
BITS = 16
PLACES_EACH, LEAST_PLACES, MOST_PLACES = 16, 1 << 20, 1 << 27

_ENDS = re.compile(r"[.,;:!?\n-\r]+")
_GAPS = re.compile(r"[ \t.,;:!?\n-\r]")
_LOWER = str.maketrans(A_Z, a_z)
_BREAK, _NONE = -1, -2


class _Vocabulary(dict):
    """Ids of words in the order of their first occurrence; ends of pieces and what is no word are negative."""

    def __init__(self):
        super().__init__({"\n": _BREAK, "": _NONE})

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self) - 2
        return out


def segments(text: str) -> Iterator[str]:
    """The text in stretches that end at a gap, so that memory is bounded by the longest word."""
    at = 0
    while at < len(text):
        gap = _GAPS.search(text, at + SEGMENT)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class _Shard:
    def __init__(self, carried: list[str]):
        self.ids, self.own, self.length = _Vocabulary(), len(carried), 0
        self.parts: list[np.ndarray] = []
        self.add(carried)

    def add(self, tokens: list[str]) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))
        ids = ids[ids != _NONE]
        self.parts.append(ids)
        self.length += len(ids)

    def row(self, lang: str) -> dict:
        stream = np.concatenate(self.parts)
        words = list(self.ids)[2:]
        mine = stream[self.own :]
        seed = lang.encode("utf-8", "surrogatepass") + b"\n"
        hashes = [int.from_bytes(hashlib.blake2b(seed + w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in words]
        counts = np.bincount(mine[mine >= 0], minlength=len(words)).tolist()
        wide = np.uint16 if len(words) < 1 << 16 else np.uint32
        return {"lang": lang, "own": self.own, "words": words, "hashes": hashes, "counts": counts, "stream": (stream + 1).astype(wide).tobytes(), "width": wide().itemsize}


SHARDS = pa.schema(
    [("lang", pa.string()), ("own", pa.int32()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary()), ("width", pa.int32())]
)


def _shards(longest: int):
    def closed(lang: str, shard: _Shard) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([shard.row(lang)], SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[str, _Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                for part in segments(text):
                    part = part.lower() if part.isascii() else part.translate(_LOWER)
                    tokens = _ENDS.sub(" \n ", part).replace("\t", " ").split(" ")
                    shard = open_shards.get(lang) or open_shards.setdefault(lang, _Shard([]))
                    shard.add(tokens)
                    if shard.length >= SHARD:
                        yield closed(lang, shard)
                        # A piece that goes on carries its last words over; they are counted where they were.
                        names, last = list(shard.ids)[2:], np.concatenate(shard.parts)[1 - longest :]
                        cut = max((i + 1 for i, w in enumerate(last) if w == _BREAK), default=0)
                        open_shards[lang] = _Shard([names[i] for i in last[cut:]])
                if lang in open_shards:
                    open_shards[lang].add(["\n"])
        for lang, shard in open_shards.items():
            yield closed(lang, shard)

    return trimmed(run)


class Likely:
    """Hashed places of what may be frequent."""

    def __init__(self, places: int, marks: bytes):
        self.places, self.marks = np.uint64(places), np.frombuffer(marks, np.uint8)

    @classmethod
    def of(cls, hashes: DataFrame) -> Likely:
        """Of a table's column `hash`: its rows set bits of a bitmap, and only that comes to the driver."""
        places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (PLACES_EACH * hashes.count()).bit_length()))
        place = F.col("hash").bitwiseAND(F.lit(places - 1)) + 1
        parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        marks = np.zeros(places // 8, np.uint8)
        for r in parts.collect():
            at = (r["part"] - 1) * 4096
            marks[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return cls(places, marks.tobytes())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) & (self.places - np.uint64(1))
        return (self.marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.view(np.uint64)) * np.uint64(0x9FB21C651E98DF25) + second.view(np.uint64)).view(np.int64)


def phrase_hash(hashes: np.ndarray) -> np.ndarray:
    """Of phrases, a row of word hashes each: that of a pair is its `pair_hash`."""
    out = hashes[:, 0]
    for i in range(1, hashes.shape[1]):
        out = pair_hash(out, hashes[:, i])
    return out


def packed(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of equal key joined by OR, sorted by key."""
    if not len(key):
        return key, bits
    order = key.argsort(kind="stable")
    key, bits = key[order], bits[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.bitwise_or.reduceat(bits, first)


def shifted(owner: np.ndarray, block: np.ndarray, bits: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's bitmap moved on by one position, its blocks sorted by owner: what leaves a block enters the next."""
    carry = bits >> (BITS - 1)
    key = np.concatenate([owner * blocks + block, (owner * blocks + block + 1)[carry > 0]])
    moved = np.concatenate([bits << np.uint16(1), carry[carry > 0]])
    key, moved = packed(key[moved > 0], moved[moved > 0])
    return key // blocks, key % blocks, moved


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each j of first[i] up to end[i]."""
    n = end - first
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


class Bitmaps:
    """Position bitmaps of the chosen words of a shard."""

    def __init__(self, stream: np.ndarray, own: int, chosen: np.ndarray):
        self.own, self.words = own, int(stream.max(initial=0)) + 1
        self.blocks = len(stream) // BITS + 2
        wanted = np.zeros(self.words, bool)
        wanted[chosen] = True
        at = np.flatnonzero((stream >= 0) & wanted[stream])
        key, self.bits = packed((at // BITS) * self.words + stream[at], (1 << (at % BITS)).astype(np.uint16))
        self.block, self.word = key // self.words, key % self.words

    def counts(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
        """Set bits of each phrase, without ends that an earlier shard has counted."""
        mine = np.where(block == 0, bits & np.uint16((0xFFFF << self.own) & 0xFFFF), bits)
        return np.bincount(phrase, np.bitwise_count(mine), n).astype(np.int64)

    def pairs(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, second word, block, bits) of all pairs, or of those wanted."""
        owner, block, bits = shifted(self.word, self.block, self.bits, self.blocks)
        order = block.argsort(kind="stable")
        owner, block, bits = owner[order], block[order], bits[order]
        bounds = np.searchsorted(self.block, np.arange(self.blocks + 1))
        out = []
        for s in range(0, len(owner), BATCH // BITS):
            o, b, m = (x[s : s + BATCH // BITS] for x in (owner, block, bits))
            i, j = ranges(bounds[b], bounds[b + 1])
            both = m[i] & self.bits[j]
            hit = both > 0
            i, j, both = i[hit], j[hit], both[hit]
            if wanted is not None:
                hit = wanted(o[i], self.word[j])
                i, j, both = i[hit], j[hit], both[hit]
            out.append((o[i], self.word[j], b[i], both))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (self.word[:0], self.word[:0], self.block[:0], self.bits[:0])

    def phrases(
        self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], longest: int, kept: Callable[[np.ndarray], np.ndarray] | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word ids of phrases, their counts) of two words up to longest whose neighbours are all wanted pairs.
        Those of three words or more that are not kept are neither given nor extended."""
        first, second, block, bits = self.pairs(wanted)
        order = np.lexsort((block, first))
        first, second, block, bits = first[order], second[order], block[order], bits[order]
        key = first * self.blocks + block
        name = first * self.words + second
        batch = np.flatnonzero(np.diff(first, prepend=-1))  # all of a first word stay together
        groups: list[tuple[int, int]] = []
        for s, e in zip(batch, [*batch[1:], len(first)], strict=False):  # nothing where there is no pair
            if groups and e - groups[-1][0] <= BATCH:
                groups[-1] = (groups[-1][0], e)
            else:
                groups.append((s, e))
        for s, e in groups:
            codes, phrase = np.unique(name[s:e], return_inverse=True)
            ids, at, ends = np.stack([codes // self.words, codes % self.words], axis=1), block[s:e], bits[s:e]
            yield ids, self.counts(phrase, at, ends, len(ids))
            while ids.shape[1] < longest and len(ids):
                owner, at, ends = shifted(phrase, at, ends, self.blocks)
                want = ids[owner, -1] * self.blocks + at
                i, j = ranges(np.searchsorted(key, want), np.searchsorted(key, want, "right"))
                both = ends[i] & bits[j]
                hit = both > 0
                i, j = i[hit], j[hit]
                codes, phrase = np.unique(owner[i] * self.words + second[j], return_inverse=True)
                ids, at, ends = np.column_stack([ids[codes // self.words], codes % self.words]), block[j], both[hit]
                if kept is not None:
                    good = kept(ids)
                    here = good[phrase]
                    ids, phrase, at, ends = ids[good], (np.cumsum(good) - 1)[phrase[here]], at[here], ends[here]
                yield ids, self.counts(phrase, at, ends, len(ids))


def _maps(batches: Iterator[pa.RecordBatch], words: Likely) -> Iterator[tuple[str, np.ndarray, np.ndarray, Bitmaps]]:
    """(lang, words, their hashes, bitmaps of the words that may be frequent) of each shard."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes = np.array(row["hashes"], np.int64)
            stream = np.frombuffer(row["stream"], {2: np.uint16, 4: np.uint32}[row["width"]]).astype(np.int64) - 1
            yield row["lang"], np.array(row["words"], object), hashes, Bitmaps(stream, row["own"], np.flatnonzero(words.has(hashes)))


def _pairs(words: Likely):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, maps in _maps(batches, words):
            a, b, block, bits = maps.pairs()
            codes, pair = np.unique(a * maps.words + b, return_inverse=True)
            n = maps.counts(pair, block, bits, len(codes))
            codes, n = codes[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(hashes[codes // maps.words], hashes[codes % maps.words])), pa.array(n.astype(np.int32))], ["hash", "f"])

    return trimmed(run)


def _threes(words: Likely, pairs: Likely):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, maps in _maps(batches, words):
            for ids, n in maps.phrases(lambda a, b: pairs.has(pair_hash(hashes[a], hashes[b])), 3):  # noqa: B023
                if ids.shape[1] == 3:
                    ids, n = ids[n > 0], n[n > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(hashes[ids])), pa.array(n.astype(np.int32))], ["hash", "f"])

    return trimmed(run)


def _phrases(words: Likely, pairs: Likely, threes: Likely | None, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, hashes, maps in _maps(batches, words):
            wanted = lambda a, b: pairs.has(pair_hash(hashes[a], hashes[b]))  # noqa: B023,E731
            kept = (lambda ids: threes.has(phrase_hash(hashes[ids[:, -3:]]))) if threes else None  # noqa: B023
            for ids, n in maps.phrases(wanted, longest, kept):
                ids, n = ids[n > 0], n[n > 0]  # without those that carried words make
                found = [" ".join(row) for row in names[ids].tolist()]
                same = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32)))
                yield pa.RecordBatch.from_arrays([same, pa.array(found, pa.string()), pa.array(np.full(len(n), ids.shape[1], np.int32)), pa.array(n)], ["lang", "phrase", "words", "f"])

    return trimmed(run)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of 1 to longest words that occur least times, (lang, n))."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = rows.mapInArrow(_shards(longest), "lang string, own int, words array<string>, hashes array<long>, counts array<long>, stream binary, width int")
    shards = scratch.cut(shards, "shards")
    totals = scratch.cut(shards.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n")), "totals")
    local = shards.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.hashes").alias("hash"), F.col("w.counts").alias("f"))
    words = local.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("hash").alias("hash")).where(F.col("f") >= least)
    words = scratch.cut(words, "words")
    streams = shards.select("lang", "own", "words", "hashes", "stream", "width")
    may = Likely.of(words.select("hash"))

    def likely(counted, name: str) -> Likely:
        hashes = streams.mapInArrow(counted, "hash long, f int").groupBy("hash").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        return Likely.of(scratch.cut(hashes.select("hash"), name))

    pairs = likely(_pairs(may), "pairs")
    threes = likely(_threes(may, pairs), "threes") if longest > 2 else None
    more = streams.mapInArrow(_phrases(may, pairs, threes, longest), "lang string, phrase string, words int, f long")
    more = more.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return words.select("lang", "phrase", F.lit(1).alias("words"), "f").unionByName(scratch.cut(more, "phrases")), totals


def collocations(
    docs: DataFrame, scratch: Scratch | None = None, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases (all of them if top is None).

    Texts (null: empty) are lower-cased in A-Z and cut into pieces at . , ; : ! ? and line ends, and pieces
    into words at blanks and tabs; a null lang is `und`. a, l and r count the phrase and the two parts of its
    lowest-scoring cut over all occurrences, n all words of the language; score is floor(1000 a n / (l r)).
    Phrases that never occur but within one longer candidate are dropped. Equal rows and copies count as often
    as they occur; texts without words give nothing, and other columns are ignored.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    scratch = scratch or Scratch(docs.sparkSession)
    found, totals = frequent_phrases(docs, scratch, longest, least, text, lang)
    candidates = found.where("words > 1")
    parts = candidates.select("lang", "phrase", "f", F.split("phrase", " ").alias("w"), "words")
    inner = parts.where("words > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    within = inner.groupBy("lang", "phrase").agg(F.max("f").alias("inner"))
    kept = parts.join(within, ["lang", "phrase"], "left").where("inner is null or inner < f")
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("transform(sequence(1, words - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') as head, array_join(slice(w, k + 1, words), ' ') as tail))")).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut.k", F.col("cut.head").alias("head"), F.col("cut.tail").alias("tail"))
    heads, tails = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)) for side, count in (("head", "l"), ("tail", "r")))
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    # 15 + 4 and 17 digits make 37, 17 and 17 make 35: both exact.
    score = F.expr("(1000 * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    best = best.select("lang", "phrase", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows, _ = ranked(scratch, best, order, "_at")
    rows = scratch.cut(rows, "ranked")
    first = scratch.cut(rows.groupBy("lang").agg(F.min("_at").alias("_first")), "first")
    out = rows.join(first, "lang").withColumn("rank", F.col("_at") - F.col("_first") + 1)
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
