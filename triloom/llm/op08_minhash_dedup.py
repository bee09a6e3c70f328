"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

1. One pass over the texts gives each document's shingle count, a digest of its shingle set and a
   key for each band of its signature. Documents with one set form a class; only the class' least
   doc_id goes on, so exact copies cost nothing further.
2. In each bucket (documents that share a band key) all are compared with the bucket's least
   document; verified links give components.
3. Buckets whose members are not all in one component yet are compared across components. A bucket
   of at most one block is a unit. In a larger one only members outside its largest component ask,
   and they ask only members that can be alike: a shingle that no other member of such buckets holds
   bounds what a document can share, and so bounds the sizes of its partners. Questions and members
   meet by size class, dealt into blocks, so a unit stays bounded; it returns a spanning forest of
   its links, never its pairs. No bucket is capped and nothing is skipped on an estimate, so every
   link between documents that share a band is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, connected_components, likely, prepare, row_keys
from triloom.llm.memory import trimmed
from triloom.llm.shingles import alike, circulant, shingle_set

#: 48 bands of 6 coordinates: a pair at 0.8 misses all bands with probability 5e-7.
ROWS, BANDS = 6, 48
#: Members of a leader's unit, and of a block; shingles that a unit or a block should hold at most.
UNIT, BLOCK, TOKENS = 256, 256, 4_000_000
#: Ratio of the size classes within which large buckets are compared.
STEP = 1.05


def sketches(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), bands."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = circulant(rows, bands)
        for batch in batches:
            count, digest, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                count.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(hasher.band_keys(s))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("i4")
            flat = np.concatenate([*keys, np.empty(0, "i8")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


_LINKS = "a long, b long"


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its sorted distinct shingle hashes as bytes, so that no later unit shingles a text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(text, words).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["doc_id", "held"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, held binary")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, own): how many shingles of a document no other one of `sets` holds. One aggregation
    by shingle with map-side combine; documents without any such shingle are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(h) // 8 for h in held])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(held), "i8")), pa.array(doc, pa.int64())], ["shingle", "doc_id"])

    flat = sets.mapInArrow(trimmed(run), "shingle long, doc_id long")
    single = flat.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1")
    return single.groupBy("doc_id").agg(F.count("*").alias("own"))


def _arrow_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def _against_leader(percent: int):
    """Rows (lead, chunk, doc_id, held) sorted so that a unit's leader comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            links = []
            for a, b, held in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                s = np.frombuffer(held, "u8")
                if a == b:
                    lead, own = a, s
                elif a == lead and alike(own, s, percent):
                    links.append((a, b))
            yield _arrow_links(links)

    return run


class _Forest(dict):
    """Union-find over whatever is hashable."""

    def root(self, x):
        at = x
        while self.setdefault(at, at) != at:
            at = self[at]
        while self[x] != at:
            self[x], x = at, self[x]
        return at


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]: products of incidence matrices,
    `width` shingles at a time, over the shingles that at least two of the sets hold."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = n > 1
    place = np.cumsum(twice) - 1
    keep = twice[at]
    at, of = place[at[keep]], of[keep]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((len(left), len(right)))
    for c in range(0, int(twice.sum()), width):
        lo, hi = np.searchsorted(at, [c, c + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[of[lo:hi], at[lo:hi] - c] = 1
        out += dense[left] @ dense[right].T
    return out.astype(np.int64)


def _unit_links(rows: list[tuple[int, int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows (role, component, doc_id, held) of different
    components: those of role 1 with those of role 0, or all among them if there is no role 1."""
    sets = [np.frombuffer(r[3], "u8") for r in rows]
    role, comp, ids = (np.array([r[i] for r in rows]) for i in range(3))
    right = np.flatnonzero(role == 0)
    left = np.flatnonzero(role == 1) if role.any() else right
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in sets])
    both = common_counts(sets, left, right)
    link = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
    forest, links = _Forest(), []
    for i, j in np.argwhere(link & (comp[left][:, None] != comp[right][None, :])):
        x, y = forest.root(int(comp[left[i]])), forest.root(int(comp[right[j]]))
        if x != y:
            forest[max(x, y)] = min(x, y)
            links.append((int(ids[left[i]]), int(ids[right[j]])))
    return links


def _within_units(keys: int, percent: int):
    """Rows (unit of `keys` columns, role, component, doc_id, held) sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            links = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != unit:
                    if rows:
                        links += _unit_links(rows, percent)
                    unit, rows = row[:keys], []
                rows.append(row[keys:])
            yield _arrow_links(links)
        if rows:
            yield _arrow_links(_unit_links(rows, percent))

    return run


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `words`-word
    shingles (A-Z lower-cased; a shorter text is one shingle, an empty or null one has none and no
    link). component_id is the least doc_id reachable, kept says doc_id = component_id. Whole texts
    count, of any length. Rows that repeat a doc_id share the links of all its texts; rows without
    doc_id are linked each by itself, and a group of them alone has no component_id. An empty table
    gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    keyed = row_keys(scratch, docs)
    if keyed is None:
        return _by_id(docs, words, percent, rows, bands, scratch)
    named_rows, key = keyed
    ids = named_rows.select(F.col(key).alias("_key"), F.col("doc_id").alias("_own"))
    found = _by_id(named_rows.select(F.col(key).alias("doc_id"), "text"), words, percent, rows, bands, scratch)
    found = scratch.cut(found.join(ids, found["doc_id"] == ids["_key"]).select("_key", "_own", "n_shingles", F.col("component_id").alias("_comp")), "by-row")
    low = scratch.cut(found.where("_own is not null").groupBy("_own").agg(F.min("_comp").alias("_low")), "by-doc")
    same = connected_components(scratch, found.join(low, "_own").select(F.col("_comp").alias("a"), F.col("_low").alias("b")))
    whole = found.join(same, found["_comp"] == same["id"], "left").select("_own", "n_shingles", F.coalesce("component", "_comp").alias("_comp"))
    named = ids.select(F.col("_key").alias("_comp"), F.col("_own").alias("component_id"))  # the least row has the least doc_id
    out = whole.join(named, "_comp").select(F.col("_own").alias("doc_id"), "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _across(placed: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components within large buckets, from rows (key, doc_id, size, comp, most).

    With c of a document's a shingles held by others, a partner of size b shares at most c of them,
    so 100 * c >= percent * (a + b - c) bounds b from above; a document whose bound lies below
    percent * a / 100 is alike to none. Such documents go, and the others meet by size class.
    """
    placed = scratch.cut(placed, "wide")
    own = _own_shingles(sets.join(placed.select("doc_id").distinct(), "doc_id", "left_semi"))
    size, other = F.col("size"), F.col("size") - F.coalesce("own", F.lit(0))
    lo = F.ceil(size * percent / 100)
    hi = F.least(F.floor(size * 100 / percent), F.floor(other * (100 + percent) / percent) - size)
    kind = lambda x: F.floor(F.log(x) / math.log(STEP)).cast("int")
    members = placed.join(scratch.cut(own, "own"), "doc_id", "left").withColumns({"lo": lo, "hi": hi}).where("hi >= lo")
    members = members.select("key", "doc_id", "comp", "most", "size", kind(size).alias("kind"), kind(F.col("lo")).alias("from"), kind(F.col("hi")).alias("to"))
    members = scratch.cut(members, "members")
    asks = members.where("comp <> most").withColumn("kind", F.explode(F.sequence("from", "to")))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / TOKENS)).cast("int")
    grid = members.groupBy("key", "kind").agg(blocks.alias("mbs")).join(asks.groupBy("key", "kind").agg(blocks.alias("qbs")), ["key", "kind"])
    grid = scratch.cut(grid, "grid")
    deal = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = ["key", "kind", "i", "j"]
    told = members.join(grid, ["key", "kind"]).withColumn("i", deal("mbs", 1)).withColumn("j", every("qbs")).select(*unit, F.lit(0).alias("role"), "comp", "doc_id")
    asking = asks.join(grid, ["key", "kind"]).withColumn("j", deal("qbs", 2)).withColumn("i", every("mbs")).select(*unit, F.lit(1).alias("role"), "comp", "doc_id")
    rows = scratch.cut(told.union(asking), "units").join(sets, "doc_id").select(*unit, "role", "comp", "doc_id", "held")
    rows = rows.repartition(*unit).sortWithinPartitions(*unit)
    return rows.mapInArrow(trimmed(_within_units(4, percent)), _LINKS)


def _by_id(docs: DataFrame, words: int, percent: int, rows: int, bands: int, scratch: Scratch) -> DataFrame:
    """near_duplicates() of rows (doc_id, text) whose doc_id is neither null nor repeated."""
    sketch = scratch.cut(sketches(docs, words, rows, bands), "sketch")
    classes = sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.cut(classes, "classes")
    reps = sketch.where("digest is not null").join(classes, "digest").where("doc_id = rep").select("doc_id", F.col("n_shingles").alias("size"), "bands")
    reps = scratch.cut(reps, "reps")

    entries = reps.select(F.explode("bands").alias("key"), "doc_id", "size")
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n"), F.sum("size").alias("tokens")).where("n > 1")
    shared = scratch.cut(shared, "shared")
    buckets = scratch.cut(entries.join(shared, "key"), "buckets")  # key, doc_id, size, lead, n, tokens
    sought = scratch.cut(buckets.select("doc_id").distinct(), "sought")
    sets = scratch.cut(shingle_sets(likely(docs, sought, "doc_id").join(sought, "doc_id", "left_semi"), words), "sets")
    scratch.free(reps, shared, sought)

    pairs = buckets.where("doc_id <> lead").select("lead", "doc_id").distinct()
    sizes = scratch.cut(pairs.groupBy("lead").agg(F.ceil(F.count("*") / UNIT).alias("chunks")), "leads")
    members = pairs.join(sizes, "lead").select("lead", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), "doc_id")
    leaders = sizes.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("lead").alias("doc_id"))
    units = members.union(leaders).join(sets, "doc_id").select("lead", "chunk", "doc_id", "held")
    units = units.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", F.col("doc_id") != F.col("lead"))
    links = scratch.cut(units.mapInArrow(trimmed(_against_leader(percent)), _LINKS), "links")
    known = scratch.cut(connected_components(scratch, links), "known")

    placed = buckets.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "size", F.coalesce("component", "doc_id").alias("comp"))
    placed = scratch.cut(placed, "placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    parts = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.max_by("comp", F.struct("n", "comp")).alias("most"))
    # A bucket of two was compared in full already.
    active = scratch.cut(parts.where("n > 2 and comps > 1"), "active")
    wide = (F.col("n") > BLOCK) | (F.col("tokens") > TOKENS)
    near = placed.join(active.where(~wide).select("key"), "key").join(sets, "doc_id").select("key", F.lit(0).alias("role"), "comp", "doc_id", "held")
    near = near.repartition("key").sortWithinPartitions("key")
    more = scratch.cut(near.mapInArrow(trimmed(_within_units(1, percent)), _LINKS), "more")
    big = active.where(wide).select("key", "most")
    if not big.isEmpty():
        far = scratch.cut(_across(placed.join(big, "key"), sets, percent, scratch), "far")
        more = scratch.cut(more.union(far), "more")

    found = scratch.cut(connected_components(scratch, known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "found")
    label = classes.join(found, classes["rep"] == found["id"], "left").where("copies > 1 or id is not null")
    label = scratch.cut(label.select("digest", F.coalesce("component", "rep").alias("component_id")), "labels")
    # All that led here has been written on; the sketch and the labels are what the result reads.
    scratch.free(classes, buckets, sets, sizes, links, known, placed, active, more, found)
    out = sketch.join(label, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
