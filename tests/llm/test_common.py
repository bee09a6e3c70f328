import random

import pytest
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, ascii_lower, connected_components, ranked


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def solve(spark, edges, kind="long"):
    e = spark.createDataFrame(edges, f"a {kind}, b {kind}, rank int".replace(", rank int", ""))
    rows = connected_components(Scratch(spark), e).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["component"] for r in rows}


def shuffled_path(n):
    names = list(range(n))
    random.Random(3).shuffle(names)
    return list(zip(names, names[1:], strict=False))


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1), (None, 2), (3, None)],
        [(2, 1), (1, 2), (2, 1)],
        [(i, i + 1) for i in range(40)],
        shuffled_path(60),
        [(99, i) for i in range(50)] + [(200, 201)],
        [(random.Random(i).randrange(80), random.Random(i + 999).randrange(80)) for i in range(60)],
    ],
)
def test_components(spark, edges):
    assert solve(spark, edges) == brute(edges)


def test_components_of_strings(spark):
    edges = [("b", "a"), ("c", "b"), ("y", "x")]
    assert solve(spark, edges, "string") == brute(edges)


def test_ranks_are_gapless_in_order(spark):
    rows = [(i % 7, i) for i in range(500)] + [(3, None), (3, 5)]
    df = spark.createDataFrame(rows, "k int, v long")
    out, n = ranked(Scratch(spark), df, [F.col("k"), F.col("v")])
    got = sorted(out.collect(), key=lambda r: r["rank"])
    assert n == len(rows) and [r["rank"] for r in got] == list(range(n))
    key = [(r["k"], -1 if r["v"] is None else r["v"]) for r in got]
    assert key == sorted(key)
    assert ranked(Scratch(spark), df.limit(0), [F.col("k")])[1] == 0


def test_lower_case_of_ascii_only(spark):
    t = spark.createDataFrame([("ABC xyz",), ("ÀÉ İß ABCZ",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(ascii_lower(F.col("t"))).collect()] == ["abc xyz", "ÀÉ İß abcz", "", None]


def test_scratch_uses_the_session_folder(spark):
    s = Scratch(spark)
    assert s.root.startswith(spark.conf.get("spark.checkpoint.dir", "") or "/")
    t = s.cut(spark.range(3), "x")
    assert t.count() == 3 and t.inputFiles()[0].removeprefix("file:").removeprefix("//").startswith(s.root.removeprefix("file:").removeprefix("//"))
    s.free(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(s.root + "/001-x")


def test_likely_rows_hold_all_that_are_sought(spark, monkeypatch):
    from triloom.llm import common

    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as _part")
    ids = spark.createDataFrame([(i,) for i in (0, 7, 4999, 123456, 7)], "doc_id long")
    assert {r["doc_id"] for r in common.likely(rows, ids, "doc_id").collect()} == {0, 7, 4999}
    monkeypatch.setattr(common, "PLACES", 64)  # crowded: more pass, none is lost
    got = common.likely(rows, ids, "doc_id")
    assert got.columns == rows.columns and {0, 7, 4999} <= {r["doc_id"] for r in got.collect()} and got.count() < 1000
    assert common.likely(rows, ids.limit(0), "doc_id").count() == 0


FRESH = """
import sys
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, {repo!r})
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
docs = spark.createDataFrame([(1, "some words are here", "en")], "doc_id long, text string, lang string")
from triloom.llm import op01_quality, op04_language_id, op08_minhash_dedup, op09_packing
{call}
print("DONE")
"""


@pytest.mark.parametrize(
    "call",
    [
        "op01_quality.score(docs, None).collect()",
        "op04_language_id.identify(docs, {'en': [1, 2]}).collect()",
        "op04_language_id.gram_counts(docs.select('text', 'lang')).collect()",
        "op08_minhash_dedup.sketches(docs.select('doc_id', 'text'), 5, 6, 4).collect()",
        "op09_packing.tokenized_pieces(docs.select('doc_id', 'text')).collect()",
    ],
)
def test_each_python_stage_ships_its_package(call, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = FRESH.format(repo=str(Path(__file__).resolve().parents[2]), call=call)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "DONE" in done.stdout, done.stderr[-2000:]
