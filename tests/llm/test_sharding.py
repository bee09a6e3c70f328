import zlib
from collections import Counter

import pytest

from triloom.llm import op10_sharding as op


def keys(spark, n=4000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def where(df, topology, out="shard"):
    return {r["doc_id"]: r[out] for r in op.assign(df, "doc_id", topology, out).collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = keys(spark)
    for n in (1, 7, 40):
        before, after = where(df, op.grid(n)), where(df, op.add_shard(op.grid(n)))
        moved = {k for k in before if before[k] != after[k]}
        assert moved and all(after[k] == n for k in moved)
        assert abs(len(moved) / 4000 - 1 / (n + 1)) < 0.04


def test_movement_is_confined_to_the_subtree_that_changed(spark):
    df = keys(spark)
    old = op.grid(40)
    new = [op.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else 1.0) for s in old]
    before, after = where(df, old), where(df, new)
    region = {s.number: s.region for s in old}
    for k in before:
        if before[k] != after[k]:
            assert region[after[k]] == region[5]
    assert Counter(after.values())[5] > 2 * Counter(before.values())[5]


def test_shares_follow_weights(spark):
    t = [op.Shard("a", "x", 0, 1.0), op.Shard("a", "y", 1, 3.0), op.Shard("b", "z", 2, 4.0), op.Shard("b", "z", 3, 0.0)]
    n = Counter(where(keys(spark, 8000), t).values())
    assert n[3] == 0 and abs(n[0] / 1000 - 1) < 0.15 and abs(n[1] / 3000 - 1) < 0.1 and abs(n[2] / 4000 - 1) < 0.1
    with pytest.raises(ValueError):
        op.assign(keys(spark, 1), "doc_id", [op.Shard("a", "x", 0, 0.0)])


def test_shards_are_recomputed_from_the_law(spark):
    import math

    import xxhash

    topology = [*op.grid(30), op.Shard("g0", "k1", 30, 2.5), op.Shard("g7", "k0", 31, 0.5)]

    def draw(key, level, name, weight):
        seed = xxhash.xxh64_intdigest(str(key).encode(), 42)
        bits = xxhash.xxh64_intdigest(f"{level}/{name}".encode(), seed) >> 12
        return -math.log((bits + 0.5) / 2**52) / weight

    def descend(key):
        regions = {s.region for s in topology}
        weight = lambda **at: sum(s.weight for s in topology if all(getattr(s, k) == v for k, v in at.items()))
        g = min(regions, key=lambda n: draw(key, "region", n, weight(region=n))) if len(regions) > 1 else next(iter(regions))
        racks = {s.rack for s in topology if s.region == g}
        r = min(racks, key=lambda n: draw(key, f"rack/{g}", n, weight(region=g, rack=n)))
        leaves = [s for s in topology if (s.region, s.rack) == (g, r)]
        return min(leaves, key=lambda s: draw(key, f"shard/{g}/{r}", s.number, s.weight)).number

    got = where(keys(spark, 500), topology)
    assert got == {k: descend(k) for k in range(500)}


def test_a_shard_added_to_a_rack_moves_rows_by_level(spark):
    old = op.grid(40)
    new = op.add_shard(old, region="g1", rack="k5")
    before, after = where(keys(spark), old), where(keys(spark), new)
    region, rack = {s.number: s.region for s in new}, {s.number: s.rack for s in new}
    for k in before:
        if before[k] != after[k]:
            assert region[after[k]] == "g1"
            assert region[before[k]] != "g1" or rack[after[k]] == "k5"
            assert rack[before[k]] != "k5" or after[k] == 40
    assert Counter(after.values())[40] > 50


def test_documents(spark, awkward):
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(i, f"t{i}") for i in range(100, 400)], "doc_id long, text string"))
    rows = op.shard_documents(docs, op.grid(40)).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    slots = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    assert op.shard_documents(docs.limit(0), op.grid(40)).count() == 0


def test_assign_keeps_columns_and_tells_names_with_slashes_apart(spark):
    topology = [op.Shard("a/b", "c", 0), op.Shard("a", "b/c", 1)]
    df = spark.range(400).selectExpr("id as k", "id as _region", "id as _rack", "id as __region")
    rows = op.assign(df, "k", topology).collect()
    assert all(r["_region"] == r["_rack"] == r["__region"] == r["k"] for r in rows)
    assert {0, 1} == {r["shard"] for r in rows}
