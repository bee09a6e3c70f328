import numpy as np
import pytest

from triloom.llm import op07_embedding_dedup as op


def brute(rows, limit=0.93):
    ok = [i for i, (v, e, y) in enumerate(rows) if v is not None and y is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, parent = {i: 0 for i in range(len(rows))}, {i: rows[i][0] for i in range(len(rows))}
    edges = []
    for n, i in enumerate(ok):
        for j in ok[:n]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= limit:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    while True:
        before = dict(parent)
        for i, j in edges:
            parent[i] = parent[j] = min(parent[i], parent[j])
        if before == parent:
            break
    return sorted(((rows[i][0], links[i], parent[i], rows[i][0] == parent[i]) for i in links), key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(v, e, y, "x") for v, e, y in rows], "vec_id long, embedding array<float>, label int, cell string")
    return sorted((tuple(r) for r in op.near_duplicates(df, **how).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = r.normal(size=dim)
        for _ in range(r.integers(1, 5)):
            out.append((len(out), (base + r.normal(size=dim) * r.choice([0, 0.1, 0.35])).astype("f4").tolist(), int(i % 3)))
    return out


def test_matches_brute_force(spark):
    rows = clustered(150, 16, 1)
    assert found(spark, rows, per_cell=8) == brute(rows)


def test_recall_of_the_index_and_cells(spark):
    """With a fine grid, most cells are not visited and the recall stays."""
    rows = clustered(400, 32, 2)
    want, got = brute(rows), found(spark, rows, per_cell=4)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    m = op.MultiIndex(np.array([r[1] for r in rows]), 8, 0.93)
    d1, d2 = m.distances(op.unit([rows[0][1]]))
    v = m.visits(d1[0], d2[0])
    cost = (d1[0][:, None] + d2[0][None, :]).ravel()
    assert [cost[c] for c in v] == sorted(cost)[: len(v)] and len(v) < 64


@pytest.mark.parametrize("seed", range(4, 8))
def test_recall_at_the_default_settings(spark, seed):
    rows = clustered(300, 24, seed)
    want, got = brute(rows), found(spark, rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_fit_on_a_sample_without_links():
    m = op.MultiIndex(np.eye(16), 4, 0.93)
    assert m._of_pairs(op.unit(np.eye(16)), m.distances(op.unit(np.eye(16))), 0.93, 0.999) == 0.0


def test_rows_of_a_repeated_id_count_each_by_itself(spark):
    near, far = [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, near, 1), (1, far, 1), (2, [0.0, 0.01, 1.0], 1), (3, [0.0, 1.0, 0.0], 1), (4, near, 2)]
    assert found(spark, rows) == sorted([(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=repr)


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 5)
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(i, (base + r.normal(size=8) * 0.3).astype("f4").tolist(), 1) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 0.0, 0.0]
    rows = [(1, good, 1), (2, good, 1), (3, good, 2), (4, good, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 0.0], 1), (8, [nan, 1.0, 0.0], 1), (9, [inf, 0.0, 0.0], 1)]
    rows += [(10, [], 1), (11, [2.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1.0], 1), (14, [-0.0, 5.0, 0.0], 1), (None, good, 1), (15, [1e-30, 0.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[4:5]) == [(5, 0, 5, True)]
    assert op.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_limit_itself_is_linked(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 1)]
    c = np.array(rows[1][1], "f4").astype(float)
    limit = c[0] / np.linalg.norm(c)
    assert found(spark, rows, limit=float(limit)) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("copies", [40])
def test_copies_count_without_pairs(spark, copies):
    rows = [(i, [1.0, 2.0], 3) for i in range(copies)] + [(copies, [1.0, 2.1], 3)]
    assert found(spark, rows) == brute(rows)
