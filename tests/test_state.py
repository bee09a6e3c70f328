import itertools
import random

import pytest

from triloom.operators import state


def frame(spark, d):
    return spark.createDataFrame(sorted(d.items()), "sample_id long, status int")


def rows(df):
    return {r["sample_id"]: r["status"] for r in df.collect()}


@pytest.fixture(scope="module")
def ab():
    r = random.Random(3)
    pick = lambda: {i: r.randrange(3) for i in r.sample(range(40), 30)}
    return pick(), pick()


def test_kleene_tables(spark, ab):
    a, b = ab
    ids = {*a, *b}
    x, y = frame(spark, a), frame(spark, b)
    assert rows(state.and_(x, y)) == {i: min(a.get(i, 0), b.get(i, 0)) for i in ids}
    assert rows(state.or_(x, y)) == {i: max(a.get(i, 0), b.get(i, 0)) for i in ids}


def test_laws(spark, ab):
    a = ab[0]
    b = {i: ab[1].get(i, 1) for i in a}
    x, y = frame(spark, a), frame(spark, b)
    n = state.not_
    assert rows(n(n(x))) == a
    assert rows(n(state.and_(x, y))) == rows(state.or_(n(x), n(y)))
    assert rows(state.and_(x, y)) == rows(state.and_(y, x))
    parts = [rows(state.select(x, k)) for k in range(3)]
    assert all(sum(p[i] == 2 for p in parts) == 1 for i in a)


def test_query_with_itself(spark, ab):
    x = frame(spark, ab[0])
    assert rows(state.and_(x, x)) == ab[0] == rows(state.or_(x, x))


def test_universes(spark, ab):
    a = ab[0]
    x = frame(spark, a)
    assert rows(state.reset_universe(x)) == {i: s for i, s in a.items() if s >= 1}
    assert rows(state.reset_universe(x, False)) == {i: 2 for i, s in a.items() if s == 2}
    u = spark.createDataFrame([(1,), (1000,)], "sample_id long")
    assert rows(state.set_universe(x, u)) == {1: a.get(1, 0), 1000: 0}
    assert rows(state.set_universe(x, None)) == {}


def test_subsample(spark):
    x = frame(spark, dict.fromkeys(range(9), 2))
    assert sum(s == 2 for s in rows(state.subsample(x, 0.55)).values()) == 5
    y = frame(spark, {0: 2, 1: 1, 2: 0})
    assert sum(s > 0 for s in rows(state.subsample(y, 0.5, include_unknown=True)).values()) == 1
    assert rows(state.subsample(x, 4, seed=1)) == rows(state.subsample(x, 4, seed=1))
    for k in (-1, 10):
        with pytest.raises(ValueError):
            state.subsample(x, k)


def test_counts_of_nothing(spark):
    r = state.counts(frame(spark, {1: 2}).where("false"), "q").first()
    assert (r["total"], r["percent_present"]) == (0, None)


def test_jaccard(spark):
    a, b = (spark.createDataFrame([(i,) for i in s], "sample_id long") for s in ((1, 2, 3), (2, 3, 4, 5)))
    assert state.jaccard(a, b).first()[0] == pytest.approx(2 / 5)
    none = a.where("false")
    assert state.jaccard(none, none).first()[0] != state.jaccard(none, none).first()[0]  # NaN


def test_all_pairs_of_statuses(spark):
    pairs = list(itertools.product(range(3), repeat=2))
    x, y = frame(spark, {i: p[0] for i, p in enumerate(pairs)}), frame(spark, {i: p[1] for i, p in enumerate(pairs)})
    assert rows(state.and_(x, y)) == {i: min(p) for i, p in enumerate(pairs)}
