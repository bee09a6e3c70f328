"""Embedding near-dedup over an inverted multi-index.

Unit vectors are split in halves with a codebook each; the pairs of codewords form the grid of
cells. Every vector is filed in its nearest cell and visits cells in the order of the multi-sequence
traversal, as far as the recall asked for needs; what it meets there is verified by cosine in double
precision. A cell is dealt into blocks, so that one task sees two bounded blocks at a time, and a
task returns counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, connected_components
from triloom.llm.memory import trimmed

#: Vectors the codebooks and the traversal's end are fitted on; vectors a cell should hold; rows of a block.
FIT_VECTORS, PER_CELL, BLOCK = 8192, 256, 1024
#: Vectors of the sample for each codeword at least, which bounds a codebook. Cells hold PER_CELL vectors
#: up to (8192 / 8) squared times that many of a label, 268 million; beyond that they grow.
PER_WORD = 8
#: Share of the pairs that the traversals must find: of those exactly at the limit in random
#: directions, and of the sample's own; vectors of the sample whose links are looked at for that.
RECALL, FIT_PAIRS = 0.999, 512


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))


class MultiIndex:
    """Codebooks of one vector length and how far a traversal goes beyond its nearest cell."""

    def __init__(self, sample: np.ndarray, k: int, limit: float, recall: float = RECALL, seed: int = 3):
        x = unit(sample)
        self.half = x.shape[1] // 2
        self.books = _codebook(x[:, : self.half], k), _codebook(x[:, self.half :], k)
        r = np.random.default_rng(seed)
        d = r.normal(size=x.shape)
        d -= (d * x).sum(axis=1, keepdims=True) * x
        norm = np.sqrt((d * d).sum(axis=1, keepdims=True))
        y = limit * x + np.sqrt(max(0.0, 1 - limit * limit)) * d / np.where(norm > 0, norm, 1)
        a, b = self.distances(x), self.distances(y)
        # Either end of a pair may find the other.
        need = np.minimum(self._slack(a, b), self._slack(b, a))
        self.slack = max(float(np.quantile(need, recall)), self._of_pairs(x, a, limit, recall)) + 1e-9

    def _of_pairs(self, x: np.ndarray, d: tuple[np.ndarray, np.ndarray], limit: float, recall: float) -> float:
        """The same for the links within the sample, which lie along its clusters: of FIT_PAIRS
        vectors, evenly spread, against all others of it; 0 if there is none."""
        need = []
        for i in np.unique(np.linspace(0, len(x) - 1, FIT_PAIRS).astype(int)):
            j = np.flatnonzero(x @ x[i] >= limit)
            j = j[j != i]
            own, other = tuple(np.repeat(t[i : i + 1], len(j), axis=0) for t in d), tuple(t[j] for t in d)
            need.append(np.minimum(self._slack(own, other), self._slack(other, own)).astype(np.float32))
        need = np.concatenate(need)
        return float(np.quantile(need, recall)) if len(need) else 0.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.half], self.books[0]), _squares(x[:, self.half :], self.books[1])

    @staticmethod
    def _slack(own, other) -> np.ndarray:
        """How much farther than its nearest cell a vector must go to reach the other's cell."""
        (d1, d2), (e1, e2) = own, other
        at = np.arange(len(d1))
        return d1[at, e1.argmin(axis=1)] - d1.min(axis=1) + d2[at, e2.argmin(axis=1)] - d2.min(axis=1)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Multi-sequence traversal: cells by ascending distance sum from a heap of candidate pairs of
        the two sorted lists, until the sum is more than slack above the nearest."""
        o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        end = s1[0] + s2[0] + self.slack
        heap, seen, out, wide = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], len(s2)
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > end:
                break
            out.append(int(o1[i]) * wide + int(o2[j]))
            for n in ((i + 1, j), (i, j + 1)):
                if n not in seen and n[0] < len(s1) and n[1] < wide:
                    seen.add(n)
                    heapq.heappush(heap, (s1[n[0]] + s2[n[1]], *n))
        return out


def _file(models: dict[int, MultiIndex]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, visits = [0] * batch.num_rows, [[0]] * batch.num_rows
            vecs = batch.column(3).to_pylist()
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                m = models[dim]
                d1, d2 = m.distances(unit([vecs[i] for i in at]))
                for n, i in enumerate(at):
                    visits[i] = m.visits(d1[n], d2[n])
                    cell[i] = visits[i][0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "cell", "visits"])

    return run


def _compare(members: list, queries: list, cell: int, limit: float) -> tuple[list[int], list[int], list[int]]:
    """(id, links to add, least id of its component in this unit) from rows (id, copies, vec, cell, visits).

    A pair that both ends' traversals meet is seen twice, so each time it counts for the visiting
    end only; one that a single end meets counts for both.
    """
    mi, qi = np.array([r[0] for r in members]), np.array([r[0] for r in queries])
    mv, qv = np.array([r[2] for r in members], np.float64), np.array([r[2] for r in queries], np.float64)
    mw, qw = np.array([r[1] for r in members]), np.array([r[1] for r in queries])
    cos = unit(qv) @ unit(mv).T
    link = cos >= limit
    for q, m in np.argwhere(np.abs(cos - limit) < 1e-9):  # rounding of the product decides nothing
        a, b = qv[q], mv[m]
        link[q, m] = a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= limit
    link &= qi[:, None] != mi[None, :]
    if not link.any():
        return [], [], []
    places = {c: i for i, c in enumerate(dict.fromkeys(r[3] for r in queries))}
    goes = np.zeros((len(members), len(places)), bool)
    for i, r in enumerate(members):
        for c in r[4]:
            if c in places:
                goes[i, places[c]] = True
    back = goes[:, [places[r[3]] for r in queries]].T  # does member m visit the cell of query q?
    ids = np.unique(np.concatenate([qi, mi]))
    add = np.zeros(len(ids), np.int64)
    np.add.at(add, np.searchsorted(ids, qi), link @ mw)
    np.add.at(add, np.searchsorted(ids, mi), (link & ~back).T @ qw)
    low = np.arange(len(ids))
    qa, ma = np.searchsorted(ids, qi), np.searchsorted(ids, mi)
    while True:
        new = low.copy()
        np.minimum.at(new, qa, np.where(link, low[ma][None, :], len(ids)).min(axis=1))
        np.minimum.at(new, ma, np.where(link, new[qa][:, None], len(ids)).min(axis=0))
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = (add > 0) | (low != np.arange(len(ids)))
    return ids[some].tolist(), add[some].tolist(), ids[low[some]].tolist()


def _search(limit: float):
    """Rows (label, dim, cell, mb, qb, role, id, copies, vec, own, visits) sorted by unit, members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def done() -> pa.RecordBatch:
            out = _compare(*held, at[2], limit) if held[0] and held[1] else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "links", "low"])

        for batch in batches:
            for *key, role, ident, copies, vec, own, visits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    if at is not None:
                        yield done()
                    at, held = key, ([], [])
                held[role].append((ident, copies, vec, own, visits))
        if at is not None:
            yield done()

    return run


def near_duplicates(
    vectors: DataFrame, limit: float = 0.93, recall: float = RECALL, fit_vectors: int = FIT_VECTORS, per_cell: int = PER_CELL, scratch: Scratch | None = None
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null and their lengths are equal, and
    linked at a cosine of `limit` or more. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do rows without vec_id. Equal vectors of a label
    are compared as one and count as often as there are rows; rows that repeat a vec_id with another
    vector or label count each by itself. component_id is the least vec_id of a component. The index is fitted on at most
    `fit_vectors` vectors of each length; every vector is filed and searches. An empty table gives
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    vec = F.col("embedding")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    ok = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vec"), ok.alias("ok"))
    good = rows.where("ok").drop("ok")
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # A class has a number of its own, as two may share their least vec_id; it holds once it is written.
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("id"), "least", "copies", "label", "vec", F.size("vec").alias("dim")), "classes")

    models = {}
    groups = classes.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # one row a vector length
    for g in groups:
        sample = classes.where(F.col("dim") == g["dim"]).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(fit_vectors).collect()
        k = int(np.clip(np.ceil(np.sqrt(g["n"] / per_cell)), 1, max(1, fit_vectors // PER_WORD)))
        models[g["dim"]] = MultiIndex(np.array([r["vec"] for r in sample]), k, limit, recall)
    kind = dict(classes.dtypes)
    filed = classes.select("id", "copies", "label", "vec", "dim").mapInArrow(
        trimmed(_file(models)), f"id long, copies long, label {kind['label']}, vec {kind['vec']}, dim int, cell int, visits array<int>"
    )
    filed = scratch.cut(filed, "filed")

    place = ["label", "dim", "cell"]
    held = scratch.cut(filed.groupBy(place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mbs")), "members")
    asks = filed.select("label", "dim", F.explode("visits").alias("cell")).groupBy(place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qbs"))
    asks = scratch.cut(asks.join(held, place), "queries")
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tail = ["id", "copies", "vec", "own", "visits"]
    sought = asks.where("qbs > 0")
    members = filed.join(sought, place).withColumns({"own": F.col("cell"), "mb": deal("mbs", 1)}).withColumn("qb", every("qbs"))
    queries = filed.withColumnRenamed("cell", "own").withColumn("cell", F.explode("visits")).join(sought, place).withColumn("qb", deal("qbs", 2)).withColumn("mb", every("mbs"))
    key = [*place, "mb", "qb"]
    units = members.select(*key, F.lit(0).alias("role"), *tail).union(queries.select(*key, F.lit(1).alias("role"), *tail))
    units = units.repartition(*key).sortWithinPartitions(*key, "role")
    found = scratch.cut(units.mapInArrow(trimmed(_search(limit)), "id long, links long, low long"), "found")

    parts = connected_components(scratch, found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "least", "copies", "label", "vec").join(links, "id", "left").join(parts, "id", "left")
    known = known.select("label", "vec", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    known = scratch.cut(known, "linked")
    lowest = scratch.cut(known.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    known = scratch.cut(known.join(lowest, "component").select("label", "vec", "n_links", "component_id"), "known")
    scratch.free(classes, filed, held, asks, found)
    out = good.join(known, ["label", "vec"], "left").select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
