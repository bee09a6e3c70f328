"""K-mer sketches and Jaccard distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.functions.hashing import canonical_kmer_hashes, most
from triloom.session import ship, written


#: Signed numbers in the order of the unsigned ones that they stand for.
SIGN = -(2**63)


def dna_sketch(seqs: DataFrame, k: int | list[int] = 31, scaled: int | None = 1000, key: str = "sample_id", num: int | None = None, abund: bool = False) -> DataFrame:
    """(key, ksize, hash[, abundance]) of canonical k-mers from (key, bases), for each k: those whose 64-bit
    hash lies in the lowest 1/scaled, or (scaled=None) the `num` lowest of each key over all its sequences.

    Hashes are signed numbers, the same that signature files hold; abundance is how often the k-mer occurs.
    Either scaled or num; null bases and those shorter than k have no hash.
    """
    if (scaled is None) == (num is None):
        raise ValueError("either scaled or num")
    ship(seqs.sparkSession)
    sizes, limit = [k] if isinstance(k, int) else list(k), np.uint64(most(scaled) if scaled else 2**64 - 1)

    def run(batches):
        for t in batches:
            rows = []
            for own, bases in zip(t[key], t["bases"], strict=True):
                for size in sizes:
                    h = canonical_kmer_hashes(bases or "", size)
                    h, n = np.unique(h[h <= limit], return_counts=True)
                    rows.append(pd.DataFrame({key: own, "ksize": size, "hash": h[:num].view("i8"), "abundance": n[:num].astype("i8")}))
            yield pd.concat(rows) if rows else pd.DataFrame({key: [], "ksize": [], "hash": [], "abundance": []})

    kind = dict(seqs.dtypes)[key]
    found = seqs.select(key, "bases").mapInPandas(run, f"`{key}` {kind}, ksize int, hash long, abundance long")
    found = found.groupBy(key, "ksize", "hash").agg(F.sum("abundance").alias("abundance"))
    if num is not None:  # a hash of the lowest of all is among the lowest of each sequence that has it
        w = Window.partitionBy(key, "ksize").orderBy(F.col("hash").bitwiseXOR(F.lit(SIGN)))
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= num).drop("_n")
    return found if abund else found.drop("abundance")


def text_sketch(docs: DataFrame, k: int = 3, prefix: str | None = "1", num: int | None = None, abund: bool = False) -> DataFrame:
    """(sample_id, ksize, hash[, abundance]) of k-word shingles: those whose md5 is below a hex prefix (a
    portable FracMinHash of density prefix/16^len), or (prefix=None) the `num` lowest of each document."""
    if (prefix is None) == (num is None):
        raise ValueError("either prefix or num")
    words = F.filter(F.split(F.lower("text"), r"[ \n]"), lambda w: w != "")
    t = docs.select("sample_id", words.alias("w")).where(F.size("w") >= k)
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.md5(F.array_join(F.slice("w", i, k), " ")))
    if num is not None and not abund:
        return t.select("sample_id", F.lit(k).alias("ksize"), F.explode(F.slice(F.array_sort(F.array_distinct(shingles)), 1, num)).alias("hash"))
    if num is not None:  # what is among the lowest of a document is among those of each of its rows that have it
        once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  a value that is used twice and computed once
        low = once(F.array_sort(shingles), lambda a: once(F.element_at(F.slice(F.array_distinct(a), 1, num), -1), lambda top: F.filter(a, lambda x: x <= top)))
        s = t.select("sample_id", F.lit(k).alias("ksize"), F.explode(low).alias("hash"))
    else:
        s = t.select("sample_id", F.lit(k).alias("ksize"), F.explode(shingles).alias("hash")).where(F.col("hash") < prefix)
    if not abund:
        return s.distinct()
    s = s.groupBy("sample_id", "ksize", "hash").agg(F.count("*").alias("abundance"))
    if num is None:
        return s
    w = Window.partitionBy("sample_id", "ksize").orderBy("hash")
    return s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= num).drop("_n")


def num_distances(sketch: DataFrame, num: int) -> DataFrame:
    """(sample_a, sample_b, distance) of bottom-`num` sketches (sample_id, hash) that share a hash, by the merge
    estimator: of the `num` lowest hashes of both together, the share that both hold. Others are at 1.
    Hashes may be signed numbers that stand for unsigned ones, or strings."""
    order = F.col("hash").bitwiseXOR(F.lit(SIGN)) if dict(sketch.dtypes)["hash"] == "bigint" else F.col("hash")
    rows = sketch.select("sample_id", order.alias("hash"))
    lists = rows.groupBy("sample_id").agg(F.collect_set("hash").alias("hashes"))  # num of them at most
    pairs = pair_counts(rows).select("sample_a", "sample_b")
    both = pairs.join(lists.select(F.col("sample_id").alias("sample_a"), F.col("hashes").alias("a")), "sample_a").join(lists.select(F.col("sample_id").alias("sample_b"), F.col("hashes").alias("b")), "sample_b")
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("a", "b")), 1, num))
    return both.select("sample_a", "sample_b", (1.0 - F.size(F.array_intersect(F.array_intersect("u", "a"), F.col("b"))) / F.size("u")).alias("distance"))


#: Rows of a sketch in a block of samples, and pairs that a unit counts at once.
_BLOCK, _AT_ONCE = 1 << 18, 1 << 21


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(whether it is of one block with itself, columns of its rows behind i and j) of each unit; rows come sorted by unit."""
    own, parts = None, []
    for t in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in t.columns]
        i, j = columns[:2]
        cut = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(i)]
        for s, e in zip(cut, cut[1:], strict=False):
            if s == e:
                continue
            if own != (i[s], j[s]):
                if parts:
                    yield own[0] == own[1], [np.concatenate(c) for c in zip(*parts, strict=True)]
                own, parts = (i[s], j[s]), []
            parts.append([c[s:e] for c in columns[2:]])
    if parts:
        yield own[0] == own[1], [np.concatenate(c) for c in zip(*parts, strict=True)]


def _counted(inside: bool, h: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(sample_a, sample_b, shared, na, nb) of a unit's pairs, about _AT_ONCE shared hashes at a time."""
    cool = h < 0
    ids, at = np.unique(np.concatenate([a, b[cool]]), return_inverse=True)
    size = np.zeros(len(ids), np.int64)
    size[at] = np.concatenate([na, nb[cool]])
    at, other = at[: len(a)], at[len(a) :]
    left, right = ~cool & (b != 1), ~cool & (b != 0)
    order = h[right].argsort(kind="stable")
    keys, partner = h[right][order], at[right][order]
    # A shared hash of few samples is a row with one partner, the others bring all their partners.
    x = np.concatenate([at[left], at[cool]])
    partner = np.concatenate([partner, other])
    first = np.concatenate([np.searchsorted(keys, h[left]), len(keys) + np.arange(len(other))])
    end = np.concatenate([np.searchsorted(keys, h[left], "right"), len(keys) + 1 + np.arange(len(other))])
    order = x.argsort(kind="stable")
    x, first, n = x[order], first[order], (end - first)[order]
    starts = np.flatnonzero(np.diff(x, prepend=-1))  # all of a sample are counted together
    upto = np.concatenate([[0], np.cumsum(n)])
    bounds = upto[np.append(starts, len(x))]
    s = 0
    while s < len(starts):
        e = max(s + 1, int(np.searchsorted(bounds, bounds[s] + _AT_ONCE, "right")) - 1)
        lo, hi = starts[s], starts[e] if e < len(starts) else len(x)
        k = np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], n[lo:hi]) + np.repeat(first[lo:hi], n[lo:hi])
        y, z = np.repeat(x[lo:hi], n[lo:hi]), partner[k]
        if inside:
            y, z = y[y < z], z[y < z]
        pair, shared = np.unique(y * len(ids) + z, return_counts=True)
        y, z = pair // len(ids), pair % len(ids)
        y, z = np.minimum(y, z), np.maximum(y, z)
        yield ids[y], ids[z], shared, size[y], size[z]
        s = e


def _pairs(sketch: DataFrame, sizes: DataFrame | None, block: int | None, hot: int, give: Callable, schema: str) -> DataFrame:
    """What `give` makes of each unit of the sketch: (inside, the columns of _counted) to record batches.

    Samples are dealt into blocks of about `block` (by default of _BLOCK rows); a unit is two blocks and has all
    hashes that they share, so each pair is counted in one unit and no pair is shuffled. A hash of at most `hot` samples comes as
    its pairs. Any other comes as its samples, once for each block that has it, and the unit makes the pairs.
    """
    ship(sketch.sparkSession)
    # Hashes get short numbers, from a table that is stored so that they stay the same.
    held = written(sketch.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "held").withColumn("h", F.monotonically_increasing_id())
    rows = sketch.join(held, "hash").select("h", "n", "sample_id")
    rows = rows.withColumn("size", F.lit(0)) if sizes is None else rows.join(sizes.select("sample_id", F.col("n").cast("int").alias("size")), "sample_id")
    rows = written(rows.select("h", "n", "sample_id", "size"), "counted")
    if block:
        m = max(-(-rows.agg(F.approx_count_distinct("sample_id")).first()[0] // block), 1)
    else:
        n = rows.count()
        m = max(-(-n // _BLOCK), min(8, n // 4096), 1)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sample_id"), F.lit(m)).cast("int"))
    cool, rest = rows.where(F.col("n") <= hot), rows.where(F.col("n") > hot)
    x, y = (cool.select("h", *[F.col(c).alias(c + k) for c in ("sample_id", "size", "own")]) for k in "xy")
    met = x.join(y, "h").where("ownx < owny or ownx = owny and sample_idx < sample_idy")
    met = met.select(F.col("ownx").alias("i"), F.col("owny").alias("j"), F.lit(-1).cast("long").alias("h"), F.col("sample_idx").alias("a"), F.col("sample_idy").alias("b"), F.col("sizex").alias("na"), F.col("sizey").alias("nb"))
    blocks = rest.groupBy("h").agg(F.collect_set("own").alias("blocks"))
    sent = rest.join(blocks, "h").withColumn("o", F.explode("blocks"))
    side = F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1).cast("long")
    sent = sent.select(F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "h", F.col("sample_id").alias("a"), side.alias("b"), F.col("size").alias("na"), F.lit(0).alias("nb"))
    units = met.union(sent).repartition(min(m * (m + 1), 4096), "i", "j").sortWithinPartitions("i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for inside, columns in _units(batches):
            yield from give(_counted(inside, *columns))

    return units.mapInArrow(run, schema)


def _batches(names: list[str], columns: list[np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + rows]) for c in columns], names)


def _distance(shared: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 1.0 - shared / (na + nb - shared).astype(float)


def pair_counts(sketch: DataFrame, block: int | None = None, hot: int = 16) -> DataFrame:
    """(sample_a, sample_b, shared) for a < b that share a hash."""

    def give(found):
        for a, b, shared, _, _ in found:
            yield from _batches(["sample_a", "sample_b", "shared"], [a, b, shared])

    return _pairs(written(sketch.select("sample_id", "hash"), "sketch"), None, block, hot, give, "sample_a long, sample_b long, shared long")


def _sized(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    sketch = written(sketch.select("sample_id", "hash"), "sketch")
    return sketch, sketch.groupBy("sample_id").agg(F.count("*").alias("n"))


def similar_pairs(sketch: DataFrame, block: int | None = None, hot: int = 16) -> DataFrame:
    """(sample_a, sample_b, distance) of the pairs with a shared hash; all others are at distance 1."""

    def give(found):
        for a, b, shared, na, nb in found:
            yield from _batches(["sample_a", "sample_b", "distance"], [a, b, _distance(shared, na, nb)])

    return _pairs(*_sized(sketch), block, hot, give, "sample_a long, sample_b long, distance double")


def spanning_pairs(sketch: DataFrame, block: int | None = None, hot: int = 16) -> DataFrame:
    """Those of similar_pairs that the least spanning tree is made of, and few others: what closes a circle of
    shorter edges within a unit is in no such tree, so each unit gives its own forest, one edge a sample at most."""

    def give(found):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for a, b, shared, na, nb in found:
            edges = [np.concatenate(c) for c in zip(kept, (a, b, _distance(shared, na, nb)), strict=True)]
            least = forest(*edges)
            kept = [c[least] for c in edges]
        yield from _batches(["sample_a", "sample_b", "distance"], kept)

    return _pairs(*_sized(sketch), block, hot, give, "sample_a long, sample_b long, distance double")


def forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the edges of the least spanning forest by Boruvka rounds; of one length the least ids come first."""
    order = np.lexsort((b, a, distance))
    ids, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    cluster, left, out = np.arange(len(ids)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        cu, cv = cluster[u[left]], cluster[v[left]]
        apart = cu != cv
        left, cu, cv = left[apart], cu[apart], cv[apart]
        if not len(left):
            return order[np.concatenate(out)]
        # Edges are in order: written last to first, a cluster's least one stays.
        best = np.full((2, len(ids)), len(a))
        best[0][cu[::-1]], best[1][cv[::-1]] = left[::-1], left[::-1]
        best = best.min(axis=0)
        own = np.flatnonzero(best < len(a))
        out.append(np.unique(best[own]))
        to = np.arange(len(ids))
        to[own] = cluster[u[best[own]]] + cluster[v[best[own]]] - own
        to = np.where((to[to] == np.arange(len(ids))) & (np.arange(len(ids)) < to), np.arange(len(ids)), to)
        while (to[to] != to).any():
            to = to[to]
        cluster = to[cluster]


def missing_sketches(sketch: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.select("sample_id").join(sketch.select("sample_id").distinct(), "sample_id", "left_anti")


def distance_matrix(sketch: DataFrame, samples: DataFrame) -> tuple[list[int], np.ndarray]:
    """(ids, matrix) of the chosen samples on the driver, as the square output demands; a sample without sketch is an error."""
    ids = sorted(r["sample_id"] for r in samples.select("sample_id").distinct().collect())
    own = sketch.join(samples.select("sample_id"), "sample_id", "left_semi")
    if (gone := missing_sketches(own, samples).count()) > 0:
        raise ValueError(f"{gone} samples have no sketch")
    m, pairs = np.ones((len(ids), len(ids))), similar_pairs(own).toArrow()
    np.fill_diagonal(m, 0)
    i, j = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("sample_a", "sample_b"))
    m[i, j] = m[j, i] = pairs.column("distance").to_numpy()
    return ids, m


def near_candidates(sketch: DataFrame, anchors: DataFrame, distance: float) -> DataFrame:
    """(anchor, sample_id, na, n): pairs that may be within a Jaccard distance below 1, none of which is lost.

    Hashes are ordered by how many samples have them. Sets that are alike share one of their first few, of
    n less the share that they must have in common, and their sizes differ by no more than that share; so
    a hash that all samples have brings nobody together as long as there are rarer ones.
    """
    share = 1 - distance
    often = sketch.groupBy("hash").agg(F.count("*").alias("times"))
    size = sketch.groupBy("sample_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample_id").orderBy("times", "hash")
    ranked = sketch.select("sample_id", "hash").join(often, "hash").withColumn("i", F.row_number().over(w)).join(size, "sample_id")
    first = ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("sample_id", "hash", "n")
    own = first.join(anchors.select("sample_id").distinct(), "sample_id", "left_semi").select(F.col("sample_id").alias("anchor"), "hash", F.col("n").alias("na"))
    met = own.join(first, "hash").where((F.col("n") >= F.col("na") * share - 1e-9) & (F.col("na") >= F.col("n") * share - 1e-9))
    return met.select("anchor", "sample_id", "na", "n").distinct()


def within(sketch: DataFrame, anchors: DataFrame, distance: float) -> DataFrame:
    """(sample_id) at Jaccard distance at most `distance` from any anchor; only samples with a sketch."""
    if distance >= 1:
        return sketch.select("sample_id").distinct()
    pairs = near_candidates(sketch, anchors, distance)
    held = sketch.select(F.col("sample_id").alias("anchor"), "hash")
    shared = pairs.join(held, "anchor").join(sketch.select("sample_id", "hash"), ["sample_id", "hash"]).groupBy("anchor", "sample_id", "na", "n").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") / (F.col("n") + F.col("na") - F.col("shared")).cast("double") >= 1 - distance).select("sample_id").distinct()
