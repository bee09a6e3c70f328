"""Consensus and alignments from variant calls, masks and reference sequences."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.operators import intervals
from triloom.operators.bases import with_bases
from triloom.schema import UNKNOWN_TYPE
from triloom.session import ship, written

#: What a full alignment shows unless told otherwise.
VARIANTS = ("SNP", "MNP", "DELETION")


def _put(bases: Column, at: Column, put: Column) -> Column:
    """bases with each string of `put` written over them from place `at` on (from 1), in the order of the
    lists; what reaches beyond the end is left out. One pass over a buffer: time is that of the
    bases and the edits together, whatever their number."""

    @F.pandas_udf("string")
    def call(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b, places, strings in rows:
            out = []
            for text, ats, puts in zip(b, places, strings, strict=True):
                if text is not None and ats is not None and len(ats):
                    buffer = bytearray(text, "utf-8")
                    for i, s in zip(ats, puts, strict=True):
                        if i <= len(buffer):
                            buffer[i - 1 : i - 1 + len(s)] = s.encode()[: len(buffer) - i + 1]
                    text = buffer.decode()
                out.append(text)
            yield pd.Series(out, dtype=object)

    return call(bases, at, put)


def core_positions(calls: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(sequence, position) of SNPs in any sample outside the samples' united masks. One row an
    alternative base: a position with two alternatives is there twice, as in the original."""
    snps = calls.where("var_type = 'SNP'").select("sequence", "position", "deletion", "insertion").distinct()
    if masks is not None:
        m = intervals.merge(masks)
        points = snps.withColumns({"p_start0": F.col("position").cast("long") - 1, "p_end0": F.col("position").cast("long")})
        hit = intervals.binned_join(points, m, intervals.contains(F.col("p_start0"))).select("sequence", "position").distinct()
        snps = snps.join(hit, ["sequence", "position"], "left_anti")
    return snps.select("sequence", "position")


def _sequence_order(names: DataFrame) -> DataFrame:
    """Column order of concatenated sequences: the last name first, then ascending."""
    w = Window.orderBy("sequence")
    n = names.select("sequence").distinct().withColumn("_i", F.row_number().over(w))
    last = F.max("_i").over(Window.partitionBy())
    return n.select("sequence", F.when(F.col("_i") == last, 0).otherwise(F.col("_i")).alias("_rank"))


def _grid(samples: DataFrame, sequences: DataFrame) -> DataFrame:
    """(sample_id, sample_name, sequence): as many rows as the result has, without bases, which come last."""
    names = F.explode(sequences.agg(F.coalesce(F.collect_set("sequence"), F.array().cast("array<string>"))).scalar())
    return samples.select("sample_id", "sample_name", names.alias("sequence"))


def _core(calls: DataFrame, refs: DataFrame, masks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The core positions (sequence, position, times, ref, _at) and the reference's core strings (sequence, bases, _rank)."""
    p = core_positions(calls, masks)
    at = p.groupBy("sequence", "position").agg(F.count("*").alias("times"))
    w = Window.partitionBy("sequence").orderBy("position")
    base = with_bases(at, refs, F.col("position"), F.lit(1))
    base = base.withColumn("_at", (F.sum("times").over(w) - F.col("times") + 1).cast("int"))
    base = written(base, "core")
    parts = F.sort_array(F.collect_list(F.struct("_at", F.repeat("ref", F.col("times").cast("int")).alias("b"))))
    core = base.groupBy("sequence").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "").alias("bases"))
    return base, written(core.join(_sequence_order(refs), "sequence"), "bases")


def _core_edits(calls: DataFrame, base: DataFrame) -> DataFrame:
    """What a sample puts over the reference's core string: no sample-by-position grid."""
    edits = calls.where("var_type = 'SNP'").groupBy("sample_id", "sequence", "position").agg(F.min("insertion").alias("alt")).join(base, ["sequence", "position"])
    return edits.select("sample_id", "sequence", F.col("_at").cast("long").alias("at"), F.repeat("alt", F.col("times").cast("int")).alias("s"), F.lit(0).alias("o"))


def core_alignment(calls: DataFrame, samples: DataFrame | None, refs: DataFrame, masks: DataFrame | None = None, reference_name: str | None = None) -> DataFrame:
    """(record_id, alignment): each sample's base at every core position, and the reference's on request.

    calls (sample_id, sequence, position, insertion, var_type); samples (sample_id, sample_name);
    refs (sequence, bases). A sample without a SNP at a position has the reference base. Without samples (None)
    it is the reference's row only.
    """
    base, core = _core(calls, refs, masks)
    own = core.select(F.lit(reference_name).alias("record_id"), "sequence", "bases")
    if samples is None:
        return concat(own, refs)
    rows = _assembled(_core_edits(calls, base), samples, core)
    return rows.union(concat(own, refs)) if reference_name else rows


def consensus(calls: DataFrame, samples: DataFrame, refs: DataFrame, masks: DataFrame | None = None, types: tuple[str, ...] = VARIANTS) -> DataFrame:
    """(record_id, sequence, bases) of the full reference length: variants put in, deletions as -, masked bases as N.

    Only variants that keep the length are applied: an insertion beyond the deleted bases is not.
    """
    edits = _edits(calls, masks, types).groupBy("sample_id", "sequence").agg(F.sort_array(F.collect_list(F.struct("o", "at", "s"))).alias("_e"))
    t = _grid(samples, refs).join(edits, ["sample_id", "sequence"], "left").join(refs, "sequence")
    ship(samples.sparkSession)
    put = _put(F.col("bases"), F.col("_e.at"), F.col("_e.s"))
    return t.select(F.col("sample_name").alias("record_id"), "sequence", put.alias("bases"))


def _edits(calls: DataFrame, masks: DataFrame | None, types: tuple[str, ...]) -> DataFrame:
    """(sample_id, sequence, at, s, o): what is put over the reference from place `at` on, by o, at and s in order."""
    kind = F.when(F.col("deletion") > F.length("insertion"), "DELETION").when(F.length("insertion") > F.col("deletion"), "INSERTION").otherwise(F.col("var_type"))
    v = calls.where(F.col("var_type") != UNKNOWN_TYPE).withColumn("_kind", kind).where(F.col("_kind").isin(*types))
    edit = v.select("sample_id", "sequence", F.col("position").cast("long").alias("at"), F.rpad("insertion", F.col("deletion"), F.lit("-")).alias("s"), F.lit(0).alias("o"))
    if masks is not None:
        m = intervals.merge(masks, ["sample_id", "sequence"])
        edit = edit.union(m.select("sample_id", "sequence", F.col("start0") + 1, F.repeat(F.lit("N"), (F.col("end0") - F.col("start0")).cast("int")), F.lit(1)))
    return edit


def full_alignment(calls: DataFrame, samples: DataFrame, refs: DataFrame, masks: DataFrame | None = None, reference_name: str | None = None, types: tuple[str, ...] = VARIANTS, digest: bool = False) -> DataFrame:
    """(record_id, alignment): concatenated consensus, the last sequence first, then ascending. With `digest` it is
    (record_id, digest): the MD5 of each row, taken where the row is made."""
    base = written(refs.join(_sequence_order(refs), "sequence").select("sequence", "_rank", "bases"), "bases")
    rows = _assembled(_edits(calls, masks, types), samples, base, digest)
    if not reference_name:
        return rows
    own = concat(base.select(F.lit(reference_name).alias("record_id"), "sequence", "bases"), refs)
    return rows.union(own.select("record_id", F.md5("alignment")) if digest else own)


#: Samples that share a copy of the base, copies at most, bytes of a batch of texts.
_SHARE, _COPIES, _TEXT = 1024, 1024, 1 << 24


def _assembled(edits: DataFrame, samples: DataFrame, base: DataFrame, digest: bool = False) -> DataFrame:
    """(record_id, alignment), or (record_id, digest), of each sample: the base (sequence, _rank, bases) in order of rank
    with the sample's edits put in, less what reaches beyond the end of a sequence.

    Samples are dealt into parts; each part gets one copy of the base and its samples' edits, so that no
    row's text is shuffled and a task holds one text and a batch of results.
    """
    given = "digest" if digest else "alignment"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["record_id", given])

        for name, _, buffer, _ in _records(batches):
            names.append(name)
            out.append(hashlib.md5(buffer).hexdigest() if digest else bytes(buffer))
            held += len(out[-1])
            if held >= _TEXT or len(out) >= 10_000:
                yield batch()
                names, out, held = [], [], 0
        if out:
            yield batch()

    return _parts(edits, samples, base).mapInArrow(run, f"record_id string, {given} string")


def _parts(edits: DataFrame, samples: DataFrame, base: DataFrame) -> DataFrame:
    """(part, kind, rank, name, bases, edits): in each part a copy of the base (kind 0) and then its samples (kind 1)."""
    ship(samples.sparkSession)
    n = min(-(-samples.count() // _SHARE), _COPIES)
    n = max(n, min(samples.sparkSession.sparkContext.defaultParallelism, 64))
    listed = edits.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "o", "at", "s"))).alias("edits"))
    own = samples.select("sample_id", F.col("sample_name").alias("name")).join(listed, "sample_id", "left")
    own = own.select(F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(0).alias("rank"), "name", F.lit(None).cast("string").alias("bases"), "edits")
    nothing = F.lit(None).cast(own.schema["edits"].dataType)
    copies = base.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(0).alias("kind"), F.col("_rank").cast("int").alias("rank"), F.col("sequence").alias("name"), "bases", nothing.alias("edits"))
    return copies.union(own).repartitionById(n, F.col("part")).sortWithinPartitions("kind", "rank")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, bytearray, list[tuple[int, int]]]]:
    """(name, base, the sample's row, where edits were put) of each sample of a part; the row is valid until the next."""
    spans, whole, buffer = {}, b"", None
    for t in batches:
        kinds, first = t["kind"].to_numpy(), int(np.count_nonzero(t["kind"].to_numpy() == 0))
        for name, bases in zip(t["name"][:first].to_pylist(), t["bases"][:first].to_pylist(), strict=True):
            bases = (bases or "").encode()
            spans[name] = len(whole), len(whole) + len(bases)
            whole += bases
        if first == len(kinds) or not spans:
            continue
        buffer = bytearray(whole) if buffer is None else buffer
        for name, own in zip(t["name"][first:].to_pylist(), t["edits"][first:].to_pylist(), strict=True):
            put = []
            for e in own or ():
                start, end = spans.get(e["sequence"], (0, 0))
                at = start + e["at"] - 1
                if at < end and e["s"]:
                    s = e["s"].encode()[: end - at]
                    buffer[at : at + len(s)] = s
                    put.append((at, at + len(s)))
            yield name, whole, buffer, put
            for a, b in put:
                buffer[a:b] = whole[a:b]


def concat(rows: DataFrame, names: DataFrame) -> DataFrame:
    rows = rows.join(_sequence_order(names), "sequence")  # one row a sequence, broadcast if found small
    parts = F.sort_array(F.collect_list(F.struct("_rank", "bases")))
    return rows.groupBy("record_id").agg(F.array_join(F.transform(parts, lambda x: x["bases"]), "").alias("alignment"))


#: Code of each byte: 1 to 4 for ACGT, 0 for anything else.
_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = (1, 2, 3, 4)
#: Pairs of deviations that are compared at once, columns of a product, rows of a batch of pairs.
_AT_ONCE, _COLUMNS, _ROWS = 1 << 20, 2048, 1 << 16


def _meet(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with x[i] = y[j], of sorted columns, about _AT_ONCE at a time."""
    first, end = np.searchsorted(y, x), np.searchsorted(y, x, "right")
    upto = np.cumsum(end - first)
    s = 0
    while s < len(x):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + _AT_ONCE, "right")))
        n = (end - first)[s:e]
        i = np.repeat(np.arange(s, e), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s:e], n)
        s = e


class _Unit:
    """Distances of two blocks of records, to which slices are added one by one. A slice is told by where its
    records deviate from its base, which has one of ACGT everywhere."""

    def __init__(self, left: list[str], right: list[str]):
        self.names = left, right
        self.at = tuple({name: k for k, name in enumerate(x)} for x in self.names)
        self.both, self.distance = (np.zeros((len(left), len(right)), np.int64) for _ in range(2))

    def add(self, size: int, *sides: list[tuple[str, bytes, bytes]]) -> None:
        """A slice of `size` columns: (record, columns, codes) of the deviations of those of each block that it has."""
        own, rec, col, code = [], [], [], []
        for rows, at in zip(sides, self.at, strict=True):
            columns = [np.frombuffer(c, np.int32) for _, c, _ in rows]
            r = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
            c, letter = np.concatenate([*columns, np.zeros(0, np.int32)]), np.frombuffer(b"".join(x for _, _, x in rows), np.uint8)
            order = c.argsort(kind="stable")
            own.append(np.array([at[name] for name, _, _ in rows], np.int64))
            rec.append(r[order])
            col.append(c[order])
            code.append(letter[order])
        shape = len(sides[0]), len(sides[1])
        if not all(shape):
            return
        valid, gone = ([np.bincount(r[(c > 0) == k], minlength=n) for r, c, n in zip(rec, code, shape, strict=True)] for k in (True, False))
        differ, both = valid[0][:, None] + valid[1][None, :], size - gone[0][:, None] - gone[1][None, :]
        # Where both deviate, what was counted for each of them is put right: one by one, or by products where many do.
        n = [np.bincount(c, minlength=size) for c in col]
        dense = n[0] * n[1] > max(shape[0] * shape[1] // 64, 16)
        (xr, xc, xl), (yr, yc, yl) = ((r[k], c[k], x[k]) for r, c, x in zip(rec, col, code, strict=True) for k in (~dense[c],))
        for i, j in _meet(xc, yc):
            a, b, place = xl[i], yl[j], xr[i] * shape[1] + yr[j]
            over = (a > 0).astype(np.int64) + (b > 0) - ((a > 0) & (b > 0) & (a != b))
            differ -= np.bincount(place, over, shape[0] * shape[1]).astype(np.int64).reshape(shape)
            both += np.bincount(place[(a == 0) & (b == 0)], minlength=shape[0] * shape[1]).reshape(shape)
        where = np.flatnonzero(dense)
        for s in range(0, len(where), _COLUMNS):
            some = where[s : s + _COLUMNS]
            grids = []
            for r, c, x, k in zip(rec, col, code, shape, strict=True):
                lo, hi = np.searchsorted(c, some[0]), np.searchsorted(c, some[-1], "right")
                r, c, x = r[lo:hi], c[lo:hi], x[lo:hi]
                keep = dense[c]
                grid = np.full((k, len(some)), 9, np.uint8)  # 9: as the base
                grid[r[keep], np.searchsorted(some, c[keep])] = x[keep]
                grids.append(grid)

            def product(first: np.ndarray, second: np.ndarray) -> np.ndarray:
                return (first.astype(np.float32) @ second.astype(np.float32).T).astype(np.int64)

            a, b = grids
            va, vb = (a > 0) & (a < 9), (b > 0) & (b < 9)
            same = sum(product(a == k, b == k) for k in (1, 2, 3, 4))
            differ -= product(va, b < 9) + product(a < 9, vb) - (product(va, vb) - same)
            both += product(a == 0, b == 0)
        here = np.ix_(*own)
        self.distance[here] += differ
        self.both[here] += both

    def pairs(self, inside: bool) -> Iterator[pa.RecordBatch]:
        """(a, b, distance) of the pairs that share a position; of one block with itself, each once."""
        names = sorted(self.at[0].keys() | self.at[1].keys())
        rank = {name: k for k, name in enumerate(names)}
        left, right = (np.array([rank[name] for name in x], np.int64) for x in self.names)
        values, step = pa.array(names, pa.string()), max(1, _ROWS // max(len(right), 1))
        for s in range(0, len(left), step):
            x, y = np.nonzero(self.both[s : s + step])
            a, b = left[s + x], right[y]
            keep = a < b if inside else a != b
            low, high = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            distance = self.distance[s : s + step][x, y][keep].astype(float)
            yield pa.RecordBatch.from_arrays([values.take(pa.array(low)), values.take(pa.array(high)), pa.array(distance)], ["a", "b", "distance"])


def _deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, own, slice, size, at, code): where a record's slice is not as its base, beyond its end too."""
    for t in batches:
        at, code, size = [], [], []
        for text, base in zip(t["bases"].to_pylist(), t["base"].to_pylist(), strict=True):
            base = _CODES[np.frombuffer(base.encode("ascii"), np.uint8)]
            own = np.zeros(len(base), np.uint8)
            own[: len(text)] = _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
            here = np.flatnonzero(own != base)
            at.append(here.astype(np.int32).tobytes())
            code.append(own[here].tobytes())
            size.append(len(base))
        yield pa.RecordBatch.from_arrays([t["record_id"], t["own"], t["slice"], pa.array(size, pa.int32()), pa.array(at, pa.binary()), pa.array(code, pa.binary())], ["record_id", "own", "slice", "size", "at", "code"])


_TOLD = "record_id string, own int, slice int, size int, at binary, code binary"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (i, j, slice, record_id, own, size, at, code) sorted by i, j and slice. Every record has a slice 0."""
    rows = (r for t in batches for r in t.to_pylist())
    for (i, j), unit in groupby(rows, lambda r: (r["i"], r["j"])):
        found = None
        for _, part in groupby(unit, lambda r: r["slice"]):
            sides, size = ([], []), 0
            for r in part:
                size = r["size"]
                for k, own in enumerate((i, j)):
                    if r["own"] == own:
                        sides[k].append((r["record_id"], r["at"], r["code"]))
            found = found or _Unit(*([name for name, _, _ in side] for side in sides))
            found.add(size, *sides)
        yield from found.pairs(i == j)


def snp_distances(alignment: DataFrame, block: int = 1024, width: int = 1 << 14) -> DataFrame:
    """(a, b, distance) for a < b: positions at which both have one of ACGT and differ, of the pairs
    that share a position. Each record_id is there once.

    Records are dealt into blocks and cut into slices. What meets in a unit of two blocks is not their texts but
    where they deviate from a base, one record's text for each slice; a unit adds up its slices one after the
    other and gives each pair once, so that neither texts nor pairs are shuffled. Any base gives the same
    distances, one that is like most records the fewest deviations.
    """
    ship(alignment.sparkSession)
    texts = written(alignment.select("record_id", F.coalesce("alignment", F.lit("")).alias("alignment")), "alignment")
    n = max(-(-texts.count() // block), 1)
    own = F.pmod(F.xxhash64("record_id"), F.lit(n)).cast("int")
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("alignment"), F.lit(1)), F.lit(width)), lambda i: F.substring("alignment", i, F.lit(width))))
    rows = texts.select("record_id", own.alias("own"), cut.alias("slice", "bases"))
    told = F.length(F.regexp_replace("bases", "[^ACGT]", ""))
    base = rows.groupBy("slice").agg(F.max_by("bases", F.struct(F.length("bases"), told, "record_id")).alias("base"))
    base = base.select("slice", F.regexp_replace("base", r"(?s)[^ACGT]", "A").alias("base"))
    rows = rows.join(F.broadcast(base), "slice").select("record_id", "own", "slice", "bases", "base")  # one record's text
    rows = written(rows.mapInArrow(_deviations, _TOLD), "deviations")
    return _distances(rows, n)


def _distances(rows: DataFrame, n: int) -> DataFrame:
    """(a, b, distance) from the deviations (_TOLD) of records in n blocks."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "slice", "record_id", "own", "size", "at", "code")
    rows = rows.repartition(min(2 * n * (n + 1), 4096), "i", "j").sortWithinPartitions("i", "j", "slice")
    return rows.mapInArrow(_compared, "a string, b string, distance double")


def core_snp_distances(calls: DataFrame, samples: DataFrame, refs: DataFrame, masks: DataFrame | None = None, block: int = 1024, width: int = 1 << 14) -> DataFrame:
    """snp_distances(core_alignment(...)) of the samples, each sample_name once, without making a text: where a row
    deviates from the reference's core string is told by its edits."""
    calls, samples, refs = (written(df, "own") for df in (calls.where("var_type = 'SNP'"), samples, refs))  # each is read several times
    base, core = _core(calls, refs, masks)
    n = max(-(-samples.count() // block), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, odd, out = None, None, []
        for name, whole, buffer, put in _records(batches):
            if base is None:
                base = _CODES[np.frombuffer(whole, np.uint8)]
                odd = np.flatnonzero(base == 0)
                base[odd] = 1
            here = np.unique(np.concatenate([odd, *(np.arange(a, b) for a, b in put)]))
            code = _CODES[np.frombuffer(bytes(buffer[k] for k in here), np.uint8)]
            here, code = here[code != base[here]], code[code != base[here]]
            own = zlib.crc32(name.encode()) % n
            ends = np.searchsorted(here, np.arange(0, max(len(base), 1), width))
            for i, (s, e) in enumerate(zip(ends, [*ends[1:], len(here)], strict=True)):
                out.append((name, own, i, min(width, len(base) - i * width), (here[s:e] - i * width).astype(np.int32).tobytes(), code[s:e].tobytes()))
            if len(out) >= 4096:
                yield _told(out)
                out = []
        if out:
            yield _told(out)

    return _distances(written(_parts(_core_edits(calls, base), samples, core).mapInArrow(run, _TOLD), "deviations"), n)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("own", pa.int32()), ("slice", pa.int32()), ("size", pa.int32()), ("at", pa.binary()), ("code", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [c for c, _ in kinds])


def distance_matrix(alignment: DataFrame) -> tuple[list[str], int, np.ndarray]:
    """(record ids, alignment length, matrix of SNP distances) on the driver, as tree building demands."""
    rows = alignment.select("record_id", F.length("alignment").alias("n")).collect()
    labels, length = sorted(r["record_id"] for r in rows), max((r["n"] for r in rows), default=0)
    at, m = {x: i for i, x in enumerate(labels)}, np.zeros((len(labels), len(labels)))
    for r in snp_distances(alignment).toLocalIterator():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["distance"]
    return labels, length, m
