import random
from fractions import Fraction

import pytest

from triloom.llm import op05_mixing as op


def targets(sizes, most=3):
    """The rule as it is told: share by weight, stop at the cap, reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: Fraction(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "é", "z", "Z", None]), r.choice([0, 1, 10, 1000])) for _ in range(r.choice([1, 5, 40]))]
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    got = {x["source"]: x["target"] for x in op.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(float(want[s]), rel=1e-9, abs=1e-9)


def rows_of(n, seed):
    r = random.Random(seed)
    return [(i, "w " * int(r.paretovariate(1.1) * 5 % 3000), r.choice(["s1", "s2", "s2", "s2", None])) for i in range(n)]


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_comes_near_its_targets(spark, monkeypatch, block):
    """With small blocks the residuals climb a tree of several levels."""
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "FAN_IN", 3)
    docs = spark.createDataFrame(rows_of(600, 1), "doc_id long, text string, source string")
    got = op.mix(docs).collect()
    assert len(got) == 600
    source = {i: s for i, _, s in rows_of(600, 1)}
    for s in ("s1", "s2", None):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op.mix(docs).collect()))


def test_fractions_are_rounded_to_neighbours(spark):
    """Every document gets its expected copies rounded down or up."""
    docs = spark.createDataFrame([(i, "a b c", s) for i, s in enumerate("xy" * 100)], "doc_id long, text string, source string")
    for r in op.mix(docs).collect():
        f = r["target"] / r["source_size"]
        assert r["copies"] in (int(f), int(f) + 1)


def test_expectation_is_kept():
    import pandas as pd

    n, p = 40, 0.3
    total = 0
    for seed in range(300):
        t = pd.DataFrame({"source": "s", "block": 0, "doc_id": range(n), "size": [1 + i % 5 for i in range(n)], "copies": 0, "p": p})
        out = op._pivot(seed, 0, True, False)(t)
        assert abs((out["copies"] * out["size"]).sum() - p * t["size"].sum()) <= 5
        total += out.set_index("doc_id")["copies"][3]
    assert abs(total / 300 - p) < 0.09


def test_awkward_rows(awkward):
    got = op.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 7)} == {0}
    assert op.mix(awkward.limit(0)).count() == 0
