import hashlib
import math

import numpy as np
import pytest

from triloom.llm import op13_vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, one part against one entry at a time."""
    by_dim = {}
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            by_dim.setdefault(len(v), []).append((i, v, label))
    out, errors = [], {}
    for dim, kept in by_dim.items():
        kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        most = op.bound(dim)
        ints = [[max(-most, min(most, math.floor(256 * x))) for x in v] for _, v, _ in kept]
        at = [p * dim // parts for p in range(parts + 1)]
        cut = [[tuple(v[a:b]) for a, b in zip(at, at[1:])] for v in ints]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]

        def near(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, z)), j) for j, z in enumerate(book))

        for _ in range(rounds):
            for p in range(parts):
                groups = {}
                for c in cut:
                    groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
                for j, g in groups.items():
                    books[p][j] = tuple(sum(x) // len(g) for x in zip(*g))
        sha = hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()
        for (i, _, label), c in zip(kept, cut):
            got = [near(c[p], books[p]) for p in range(parts)]
            error = sum(d for d, _ in got)
            errors[label] = errors.get(label, 0) + error
            out.append((i, "".join(f"{j:02x}" for _, j in got), error, label, sha))
    return sorted(((i, code, e, errors[label], sha) for i, code, e, label, sha in out), key=repr)


def found(df, **named):
    return sorted((tuple(r) for r in op.vector_codes(df, **named).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(n, dim, seed=1, scale=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, dim)) * scale
    return [(i, (centres[i % 7] + r.normal(size=dim) * 0.1).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]


def test_clusters_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 150)  # several trees a task
    rows = vectors(500, 32)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_trees_assign_like_brute_force_with_ties():
    r = np.random.default_rng(4)
    for n, k, w in ((1, 1, 3), (40, 5, 1), (700, 64, 4), (700, 256, 2), (300, 9, 0)):
        points = r.integers(-6, 6, size=(n, w)).astype(np.int32)  # many repeats and equal distances
        book = r.integers(-6, 6, size=(k, w)).astype(np.int64)
        far = ((points[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2)
        tree = op.Tree.build(points)
        codes, error = tree.codes(book)
        assert (codes == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        expect = np.zeros((k, w + 1), np.int64)
        np.add.at(expect, far.argmin(axis=1), np.column_stack([points, np.ones(n, np.int64)]))
        assert (tree.sums(book) == expect).all()


def test_a_subtree_is_assigned_at_once():
    """Far-apart clusters are told apart near the roots, not at the leaves."""
    r = np.random.default_rng(2)
    points = np.concatenate([r.integers(0, 50, size=(4096, 4)) + 100_000 * i for i in range(4)]).astype(np.int32)
    book = np.array([[100_000 * i] * 4 for i in range(4)], np.int64)
    ranges = [x for first, *_ in op.Tree.build(points).filtered(book) for x in first]
    assert len(ranges) == 4


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.1] * 16, 1), (3, [0.1] * 15 + [nan], 1), (4, [0.1] * 15 + [None], 1), (5, [inf] + [0.1] * 15, None), (6, [0.0] * 16, None)]
    rows += [(7, [], 2), (8, [1.5], 2), (9, [-0.001] * 19, 2), (9, [-0.001] * 19, 2), (None, [0.2] * 16, 2), (10, [3e38, -3e38] * 8, 2), (2, [0.1] * 16, 1), (2, [-0.3] * 16, 1)]
    df = spark.createDataFrame([(*r, 1.0, "x", "y", 3) for r in rows], f"{SCHEMA}, error double, code string, ids string, dim int")
    assert found(df) == brute(rows)


def test_few_or_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []
    rows = vectors(3, 16)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_other_columns_types_and_sizes(spark):
    rows = vectors(90, 8, seed=3)
    df = spark.createDataFrame([(f"k{i:03d}", v, label) for i, v, label in rows], "name string, v array<double>, kind string")
    got = found(df, ident="name", vector="v", label="kind", parts=4, entries=10, rounds=3)
    assert got == brute([(f"k{i:03d}", v, label) for i, v, label in rows], 4, 10, 3)
    with pytest.raises(ValueError):
        op.vector_codes(df, entries=300)


def test_one_hot_label_and_copies(spark):
    rows = [(i, [0.25, -0.5] * 8, 7) for i in range(300)] + [(300 + i, v, 7) for i, v, _ in vectors(40, 16)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
