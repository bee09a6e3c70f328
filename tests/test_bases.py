import random

from pyspark.sql import functions as F

from triloom.operators import bases


def test_bases_are_those_of_the_whole_sequence(spark, monkeypatch):
    monkeypatch.setattr(bases, "STEPS", (4, 16))
    r = random.Random(3)
    seqs = {"a": "".join(r.choice("ACGT") for _ in range(131)), "b": "AC\nG\U0001f600T", "c": "", "d": None}
    rows = [(s, p, n) for s in "abcx" for p in (0, 1, 4, 5, 16, 17, 100, 131, 132, 150) for n in (0, 1, 3, 4, 5, 16, 17, 40, 200)] + [("a", None, 2), ("a", 3, None), ("d", 1, 1)]
    t = spark.createDataFrame(rows, "sequence string, position int, n int")
    s = spark.createDataFrame(list(seqs.items()), "sequence string, bases string")
    want = t.join(s, "sequence").select("sequence", "position", "n", F.substring("bases", F.col("position"), F.col("n")).alias("ref"))
    got = bases.with_bases(t, s, F.col("position"), F.col("n"))
    text = lambda x: sorted((*map(str, r[:3]), r[3] or "") for r in x.collect())
    assert text(got) == text(want)


def test_many_places_of_a_long_sequence(spark):
    n = 1 << 20
    s = spark.createDataFrame([("a", "ACGT" * (n // 4))], "sequence string, bases string")
    t = spark.range(200_000).select(F.lit("a").alias("sequence"), (n - F.col("id")).cast("int").alias("position"))
    got = bases.with_bases(t, s, F.col("position"), F.lit(2))
    want = F.substring(F.lit("ACGTAC"), (F.col("position") - 1) % 4 + 1, F.when(F.col("position") == n, 1).otherwise(2))
    assert (got.count(), got.where(F.col("ref") != want).count()) == (200_000, 0)


def test_queries_meet_pieces_and_no_whole_sequence(spark):
    from triloom.plans import catalog

    for name in ("spdi_to_spdi_ref", "spdi_normalize", "fill_type_tag"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "_piece" in plan and "repeat(CGTA" not in plan
