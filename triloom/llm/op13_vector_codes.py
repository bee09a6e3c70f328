"""Vector code compression: product codebooks by Lloyd rounds with the filtering algorithm.

Vectors become integers and are cut into parts. Tasks gather vectors into chunks and build a kd-tree over
each part position of a chunk once; boxes, sums and counts of its nodes are stored with it. A round goes
down the trees with the codebook: entries that are nowhere nearest within a node's box are dropped, and
once a single entry is left, the whole subtree is assigned with its cached sum and count. Sums of tasks
are added up by Spark; the driver holds the codebooks and nothing else. All arithmetic is in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.llm.common import Scratch
from triloom.llm.memory import trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a chunk, and the points up to which a node of a tree is not split.
CHUNK, LEAF = 8192, 16


def bound(dim: int) -> int:
    """The largest magnitude of a component at which squared distances of whole vectors fit a long."""
    return isqrt((2**63 - 1) // (4 * max(dim, 1)))


def integers(x: np.ndarray) -> np.ndarray:
    most = bound(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x.astype(np.float64)), -most, most).astype(np.int32)


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts begin: equal ones if parts divides dim, else their widths differ by one at most."""
    return [i * dim // parts for i in range(parts + 1)]


def starts(n: int) -> list[np.ndarray]:
    """Of each level of the balanced tree over n points, where its nodes begin (and n at the end)."""
    out = [np.array([0, n])]
    while n > LEAF << (len(out) - 1):
        s = out[-1]
        both = np.empty(2 * len(s) - 1, np.int64)
        both[0::2], both[1::2] = s, s[:-1] + np.diff(s) // 2
        out.append(both)
    return out


class Tree:
    """A kd-tree over points, whose nodes are ranges of them; lo, hi and total list the nodes level by level."""

    def __init__(self, order: np.ndarray, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, total: np.ndarray):
        self.order, self.points, self.lo, self.hi, self.total = order, points, lo, hi, total
        self.starts = starts(len(points))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        order, lo, hi, total = np.arange(len(points), dtype=np.int32), [], [], []
        levels = starts(len(points))
        for depth, s in enumerate(levels):
            sorted_points = points[order]
            lo.append(np.minimum.reduceat(sorted_points, s[:-1]))
            hi.append(np.maximum.reduceat(sorted_points, s[:-1]))
            total.append(np.add.reduceat(sorted_points, s[:-1], dtype=np.int64))
            if depth + 1 < len(levels) and points.shape[1]:
                node = np.repeat(np.arange(len(s) - 1), np.diff(s))
                widest = (hi[-1].astype(np.int64) - lo[-1]).argmax(axis=1)
                order = order[np.lexsort((sorted_points[np.arange(len(order)), widest[node]], node))]
        return cls(order, points[order], np.concatenate(lo), np.concatenate(hi), np.concatenate(total))

    def filtered(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first, end, nearest entry, sum) of ranges that together are all points. Ties go to lower entries."""
        entries, at = np.arange(len(book)), np.zeros(1, np.int64)
        alive, offset = np.ones((1, len(book)), bool), 0
        for depth, s in enumerate(self.starts):
            lo, hi = self.lo[offset + at].astype(np.int64), self.hi[offset + at].astype(np.int64)
            middle = ((2 * book[None] - (lo + hi)[:, None]) ** 2).sum(axis=2)
            best = np.where(alive, middle, np.iinfo(np.int64).max).argmin(axis=1)
            own = book[best][:, None]
            # The corner of the box that lies farthest from the best entry towards the other one.
            corner = np.where(book[None] > own, hi[:, None], lo[:, None])
            other, mine = ((book[None] - corner) ** 2).sum(axis=2), ((own - corner) ** 2).sum(axis=2)
            alive &= ~((other > mine) | (other == mine) & (entries > best[:, None]))
            alive[np.arange(len(best)), best] = True
            done = alive.sum(axis=1) == 1
            if done.any():
                n = at[done]
                yield s[n], s[n + 1], best[done], self.total[offset + n]
            at, alive, offset = at[~done], alive[~done], offset + len(s) - 1
            if not len(at):
                return
            if depth + 1 < len(self.starts):
                at, alive = np.stack([2 * at, 2 * at + 1], axis=1).ravel(), np.repeat(alive, 2, axis=0)
            else:
                size = np.diff(s)[at]
                i = np.repeat(s[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                far = ((self.points[i].astype(np.int64)[:, None] - book[None]) ** 2).sum(axis=2)
                nearest = np.where(np.repeat(alive, size, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)
                yield i, i + 1, nearest, self.points[i].astype(np.int64)

    def sums(self, book: np.ndarray) -> np.ndarray:
        """Of each entry, the componentwise sum of the points nearest to it and, last, their number."""
        out = np.zeros((len(book), book.shape[1] + 1), np.int64)
        for first, end, entry, total in self.filtered(book):
            np.add.at(out, entry, np.column_stack([total, end - first]))
        return out

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point, in the order in which the tree was given them."""
        step = np.zeros(len(self.points) + 1, np.int64)
        for first, end, entry, _ in self.filtered(book):
            np.add.at(step, first, entry)
            np.add.at(step, end, -entry)
        nearest = np.cumsum(step[:-1])
        far = ((self.points - book[nearest]) ** 2).sum(axis=1)
        codes, error = np.empty_like(nearest), np.empty_like(far)
        codes[self.order], error[self.order] = nearest, far
        return codes, error


#: A tree as columns of bytes.
FIELDS = {"order": np.int32, "points": np.int32, "lo": np.int32, "hi": np.int32, "total": np.int64}


def _planted(parts: int, ids: pa.DataType, labels: pa.DataType):
    names = ["dim", "ids", "labels", *FIELDS]
    types = [pa.int32(), pa.list_(ids), pa.list_(labels), *[pa.list_(pa.binary())] * len(FIELDS)]

    def chunk(dim: int, rows: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        x, at = np.concatenate([r[2] for r in rows]), cuts(dim, parts)
        trees = [Tree.build(x[:, a:b]) for a, b in zip(at, at[1:], strict=False)]
        values = [[dim], *[[pa.concat_arrays([r[i] for r in rows]).to_pylist()] for i in (0, 1)], *[[[getattr(t, f).astype(d).tobytes() for t in trees]] for f, d in FIELDS.items()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lists = batch.column(2)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = integers(flat[first[at][:, None] + np.arange(dim)].reshape(len(at), dim))
                for i in range(0, len(at), CHUNK):
                    pick = pa.array(at[i : i + CHUNK])
                    held.setdefault(dim, []).append((batch.column(0).take(pick), batch.column(1).take(pick), x[i : i + CHUNK]))
                    if sum(len(r[2]) for r in held[dim]) >= CHUNK:
                        yield chunk(dim, held.pop(dim))
        for dim, rows in held.items():
            yield chunk(dim, rows)

    return trimmed(run)


def _trees(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, int, list[Tree]]]:
    """(row, vector length, trees) of each chunk."""
    for row in range(batch.num_rows):
        dim = batch.column(0)[row].as_py()
        at = cuts(dim, parts)
        bytes_of = {f: batch.column(f)[row].as_py() for f in FIELDS}
        n = len(bytes_of["order"][0]) // 4
        shape = lambda f, b, w: b if f == "order" else b.reshape(-1, w) if w else b.reshape(n if f == "points" else sum(len(s) - 1 for s in starts(n)), 0)
        yield row, dim, [Tree(**{f: shape(f, np.frombuffer(bytes_of[f][p], d), at[p + 1] - at[p]) for f, d in FIELDS.items()}) for p in range(parts)]


def _sums(books: dict[int, list[np.ndarray]], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, dim, trees in _trees(batch, parts):
                for p, tree in enumerate(trees):
                    got = tree.sums(books[dim][p])
                    added[dim, p] = added[dim, p] + got if (dim, p) in added else got
        rows = [{"dim": d, "part": p, "entry": e, "sums": s[e].tolist()} for (d, p), s in added.items() for e in np.flatnonzero(s[:, -1]).tolist()]
        schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(rows, schema)

    return trimmed(run)


def _coded(books: dict[int, list[np.ndarray]], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, dim, trees in _trees(batch, parts):
                got = [t.codes(b) for t, b in zip(trees, books[dim], strict=True)]
                codes = np.stack([g[0] for g in got], axis=1).astype(np.uint8)
                error = sum(g[1] for g in got)
                text = codes.tobytes().hex()
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(codes))], pa.string()), pa.array(error, pa.int64()), pa.array([dim] * len(codes), pa.int32())],
                    ["vec_id", "label", "code", "error", "dim"],
                )

    return trimmed(run)


def first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, list[np.ndarray]]:
    """Of each vector length, the parts of its vectors with the smallest ids; that many rows come to the driver."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "vec")
    low = rows.select(F.size("vec").alias("dim"), "vec_id", "vec").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= entries)
    by_dim: dict[int, list] = {}
    for r in sorted(low.select("dim", "rank", "vec").collect(), key=lambda r: (r["dim"], r["rank"])):
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    out = {}
    for dim, vecs in by_dim.items():
        x, at = integers(np.array(vecs, np.float64).reshape(len(vecs), dim)).astype(np.int64), cuts(dim, parts)
        out[dim] = [x[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    return out


def compress(
    vectors: DataFrame, scratch: Scratch | None = None, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, dim) of each vector that is kept, and the codebooks by vector length.

    Vectors that are null or hold null or non-finite components are dropped. A component x is the integer
    floor(256 * x), or the nearest one within `bound`, beyond which distances would not fit a long.
    Vectors of each length have codebooks of their own (64 vectors a length are held by the driver and the
    tasks); where 16 does not divide the length, parts differ by one component. Fewer than 64 vectors
    make fewer entries; empty vectors have code 00...0 and error 0. Rows that repeat an id are vectors each;
    null ids come last, and ties of ids go by the components. An empty table gives no rows; other columns
    are ignored. At most 256 entries, as a code has two digits a part.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    scratch = scratch or Scratch(vectors.sparkSession)
    number = F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(F.col(ident).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec")).where("vec is not null").where(number)
    books = first_books(rows, parts, entries)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    arrow = [pa.array([], f.type).type for f in rows.limit(0).toArrow().schema]
    fields = ", ".join(f"`{f}` array<binary>" for f in FIELDS)
    trees = rows.mapInArrow(_planted(parts, arrow[0], arrow[1]), f"dim int, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, {fields}")
    trees = scratch.cut(trees, "trees")
    for _ in range(rounds):
        sums = trees.select("dim", *FIELDS).mapInArrow(_sums(books, parts), "dim int, part int, entry int, sums array<long>")
        sums = sums.select("dim", "part", "entry", F.posexplode("sums").alias("at", "value")).groupBy("dim", "part", "entry", "at").agg(F.sum("value").alias("value"))
        by_entry: dict[tuple[int, int, int], dict[int, int]] = {}
        for r in sums.collect():  # as many as the codebooks have components
            by_entry.setdefault((r["dim"], r["part"], r["entry"]), {})[r["at"]] = r["value"]
        books = {d: [b.copy() for b in book] for d, book in books.items()}
        for (d, p, e), s in by_entry.items():
            w = books[d][p].shape[1]
            books[d][p][e] = [s[i] // s[w] for i in range(w)]
    coded = trees.mapInArrow(_coded(books, parts), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, dim int")
    return coded, books


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for part in book for entry in part.tolist() for v in entry).encode()).hexdigest()


def vector_codes(vectors: DataFrame, scratch: Scratch | None = None, **named) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that is kept, as `compress` says.

    label_error sums the errors of equal labels, nulls together (null where no long holds it);
    codebooks_sha256 is that of the vector's length.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    coded, books = compress(vectors, scratch, **named)
    coded = scratch.cut(coded, "coded")
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("total")).select("_label", F.expr("try_cast(total as long)").alias("label_error"))
    by_label = scratch.cut(by_label, "labels")
    sha = F.create_map(*[F.lit(v) for d, b in books.items() for v in (d, digest(b))]) if books else F.create_map(F.lit(-1), F.lit(""))
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.element_at(sha, F.col("dim")).alias("codebooks_sha256"))
