import random

import pytest
from pyspark.sql import functions as F

from triloom.operators import intervals


def table(spark, rows):
    return spark.createDataFrame(rows, "sequence string, start0 long, end0 long")


def got(df):
    return sorted((r["sequence"], r["start0"], r["end0"]) for r in df.select("sequence", "start0", "end0").collect())


def runs(points):
    out = []
    for s, p in sorted(points):
        if out and out[-1][0] == s and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([s, p, p + 1])
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def ab():
    r = random.Random(1)
    make = lambda: [(c, s, s + r.randrange(1, 9)) for c in "xy" for s in (r.randrange(100) for _ in range(12))]
    return make(), make()


def points(rows):
    return {(s, p) for s, a, b in rows for p in range(a, b)}


def test_algebra_matches_sets_of_positions(spark, ab):
    a, b = (table(spark, x) for x in ab)
    pa, pb = map(points, ab)
    assert got(intervals.merge(a)) == runs(pa)
    assert got(intervals.intersect(a, b)) == runs(pa & pb)
    assert got(intervals.subtract(a, b)) == runs(pa - pb)
    assert got(intervals.union_all([a, b])) == runs(pa | pb)
    lengths = spark.createDataFrame([("x", 120), ("y", 90), ("z", 5)], "sequence string, length int")
    every = {(s, p) for s, n in (("x", 120), ("y", 90), ("z", 5)) for p in range(n)}
    assert got(intervals.complement(a, lengths)) == runs(every - pa)


def test_bookended_merge_and_empty_union(spark):
    assert got(intervals.merge(table(spark, [("s", 0, 4), ("s", 4, 6)]))) == [("s", 0, 6)]
    with pytest.raises(ValueError):
        intervals.union_all([])


def test_mask_of_sequence(spark):
    s = spark.createDataFrame([("r", "ATCG-NN"), ("q", "ACGT"), ("e", "")], "sequence string, bases string")
    m = intervals.from_sequences(s)
    assert got(m) == [("r", 4, 7)]
    assert intervals.length(m).first()[0] == 3
    assert sorted(r["position"] for r in intervals.unknown_features(m).collect()) == [5, 6, 7]


@pytest.mark.parametrize(
    ("start", "stop", "hit"),
    [(10, 12, True), (12, 30, True), (5, 25, True), (5, 15, False), (5, 20, False), (20, 30, False), (0, 10, False)],
)
def test_asymmetric_overlap(spark, start, stop, hit):
    m = table(spark, [("s", 10, 20)])
    assert m.select(intervals.overlaps_range(F.lit(start), F.lit(stop))).first()[0] is hit


def test_binned_join_is_the_plain_join(spark, ab):
    a = table(spark, ab[0]).select("sequence", F.col("start0").alias("p_start0"), F.col("end0").alias("p_end0"))
    b = table(spark, ab[1])
    on = intervals.overlaps(F.col("p_start0"), F.col("p_end0"))
    pairs = sorted(map(tuple, intervals.binned_join(a, b, on, width=4).select("sequence", "p_start0", "p_end0", "start0", "end0").collect()))
    want = sorted((s, x, y, u, v) for s, x, y in ab[0] for t, u, v in ab[1] if s == t and u < y and x < v)
    assert pairs == want


def test_mask_genome(spark):
    s = spark.createDataFrame([("r", "ACGTACGT"), ("q", "AC")], "sequence string, bases string")
    m = table(spark, [("r", 1, 3), ("r", 6, 99)])
    assert {r["sequence"]: r["bases"] for r in intervals.mask_genome(s, m).collect()} == {"r": "A??TAC??", "q": "AC"}
    assert {r["sequence"]: r["bases"] for r in intervals.mask_genome(s, m, None).collect()} == {"r": "ATAC", "q": "AC"}


def test_long_intervals_over_many_spans(spark, monkeypatch):
    """Merging, intersection and difference against sets of positions, with spans of 8 positions."""
    import random

    monkeypatch.setattr(intervals, "_SPAN", 8)
    r = random.Random(3)

    def some(n):
        out = []
        for _ in range(n):
            s = r.randrange(200)
            out.append((r.choice("xy"), s, s + r.choice([0, 1, 3, 8, 16, 40])))
        return out

    a, b = some(40), some(30)
    table = lambda rows: spark.createDataFrame(rows, "sequence string, start0 long, end0 long")
    points = lambda rows: {(k, p) for k, s, e in rows for p in range(s, e)}

    def runs(p):
        out = []
        for k, x in sorted(p):
            if out and out[-1][0] == k and out[-1][2] == x:
                out[-1] = (k, out[-1][1], x + 1)
            else:
                out.append((k, x, x + 1))
        return out

    got = lambda t: sorted(tuple(x) for x in t.select("sequence", "start0", "end0").where("end0 > start0").collect())
    pa, pb = points(a), points(b)
    assert got(intervals.merge(table(a))) == runs(pa)
    assert got(intervals.intersect(table(a), table(b))) == runs(pa & pb)
    assert got(intervals.subtract(table(a), table(b))) == runs(pa - pb)
    assert got(intervals.union_all([table(a), table(b)])) == runs(pa | pb)


def test_mask_genome_over_slices(spark):
    """Against a buffer, with intervals across slices, beyond the end, empty ones, and no bases."""
    import random

    r = random.Random(6)
    seqs = {"a": "".join(r.choice("ACGT") for _ in range(3 * intervals.SLICE + 77)), "b": "ACG", "c": "", "d": None, "e": "A" * intervals.SLICE}
    masks = [(k, s, s + r.choice([0, 1, 40, 3000])) for k in "abe" for s in (r.randrange(7000) for _ in range(30))]
    s = spark.createDataFrame(list(seqs.items()), "sequence string, bases string")
    m = spark.createDataFrame(masks, "sequence string, start0 long, end0 long")
    got = {x["sequence"]: x["bases"] for x in intervals.mask_genome(s, m).collect()}
    for name, bases in seqs.items():
        want = None if bases is None else list(bases)
        for k, lo, hi in masks:
            if k == name:
                want[lo:hi] = "?" * len(want[lo:hi])
        assert got[name] == (None if want is None else "".join(want))


def test_mask_genome_is_linear(spark):
    """Four times the bases and intervals take nothing like sixteen times as long."""
    import time

    took = []
    for n in (4_000, 4_000, 16_000):
        s = spark.createDataFrame([("a", "ACGTA" * (n * 10))], "sequence string, bases string")
        m = spark.range(n).selectExpr("'a' as sequence", "id * 50 as start0", "id * 50 + 3 as end0")
        began = time.time()
        bases = intervals.mask_genome(s, m).first()["bases"]
        took.append(time.time() - began)
        assert bases.count("?") == 3 * n
    assert took[2] < 10 * max(took[1], 1)


def test_one_hot_span_sorts_a_row_a_start(spark, monkeypatch):
    """Intervals of many samples on one span: islands are found among its starts, not among all of them."""
    monkeypatch.setattr(intervals, "_SPAN", 64)
    seen = []
    plain = intervals._islands
    monkeypatch.setattr(intervals, "_islands", lambda a, keys: seen.append((a.count(), keys)) or plain(a, keys))
    rows = [("r", i % 60, i % 60 + 1 + i % 3) for i in range(6000)]
    a = spark.createDataFrame(rows, "sequence string, start0 long, end0 long")
    assert [tuple(x) for x in intervals.merge(a).collect()] == [("r", 0, 62)]
    assert max(n for n, keys in seen if "_span" in keys) <= 64


def test_coverage_counts_every_interval_over_a_position(spark):
    rows = [("x", 3, 8), ("x", 3, 8), ("x", 5, 6), ("x", 8, 9), ("x", 4, 4), ("y", 65530, 65540), ("y", 65535, 65537)]
    n = {}
    for s, a, b in rows:
        for p in range(a, b):
            n[s, p] = n.get((s, p), 0) + 1
    found = intervals.positions(intervals.coverage(table(spark, rows))).collect()
    assert {(r["sequence"], r["position"]): r["n"] for r in found} == n and len(found) == len(n)
