"""Plans of the registered queries: what they shuffle, and how their tasks are sized."""

import re

import pytest

from triloom.plans.projection import Tables
from triloom.session import bounded_tasks

KEYS = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")


@pytest.fixture
def conf(spark):
    before = {k: spark.conf.get(k, None) for k in KEYS}
    yield spark.conf
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def star(spark, tmp_path):
    """Two lines of one order that are the same call, one of them with unset flags."""
    spark.createDataFrame([(1, 7, 3, "N", "O", 1), (1, 7, 3, None, None, 1), (1, 7, 3, "R", "F", 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_tasks_are_bounded_and_finer_settings_stay(spark, conf, tmp_path):
    for k in KEYS:
        conf.unset(k)
    (tmp_path / "big").write_bytes(b"x" * (41 << 20))
    bounded_tasks(spark, str(tmp_path))
    assert [conf.get(k) for k in KEYS] == ["11", str(16 << 20), str(32 << 20)]
    conf.set(KEYS[1], "8m")
    conf.set(KEYS[0], "99")
    bounded_tasks(spark, str(tmp_path))
    assert conf.get(KEYS[1]) == "8m" and conf.get(KEYS[0]) == "99"


def test_calls_are_made_distinct_as_numbers(spark, star):
    t = Tables(spark, star)
    assert sorted(r["spdi"] for r in t.calls.collect()) == ["chr3:8:1:?", "chr3:8:2:T"]
    assert [(r["variant_id"], r["impact"], r["ann_id"]) for r in t.annotation_rows.collect()] == [("chr3:8", "MODERATE", 1)]
    plan = t.calls._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[sample_id#\w+, seq#\w+, l_partkey#\w+, unknown#\w+\]", plan)


def test_annotation_rows_are_shuffled_once(spark, star, conf):
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = Tables(spark, star).annotation_rows._jdf.queryExecution().executedPlan().toString()
    conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_only_what_is_asked_for_is_stored(spark, star):
    from triloom.index import SampleIndex

    index = Tables(spark, star).stored("calls")
    assert isinstance(index, SampleIndex) and index._there("calls") and not index._there("mlst") and not index._there("annotations")
    again = Tables(spark, star).stored("calls", "reference_sequences")
    assert again.root == index.root and again.calls.count() == 2
    assert [(r["sequence"], r["length"]) for r in again.sequences.collect()] == [("chr3", 11)]


def test_lowest_hashes_with_counts_shuffle_no_other_hash(spark):
    from triloom.operators import kmer

    text = " ".join(f"w{i % 7}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (1, text + " a b c d"), (2, "one two three"), (3, "x"), (4, None)], "sample_id long, text string")
    whole = kmer.text_sketch(docs, prefix="g", abund=True)
    want = sorted(tuple(r) for r in whole.collect())
    for num in (1, 3, 500):
        kept = [r for i in (1, 2) for r in [x for x in want if x[0] == i][:num]]
        assert sorted(tuple(r) for r in kmer.text_sketch(docs, prefix=None, num=num, abund=True).collect()) == kept
    plan = kmer.text_sketch(docs, prefix=None, num=3, abund=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" in plan


def test_a_file_may_hold_several_definitions():
    import json

    from triloom.operators.typing import definitions

    one = {"label": "a", "tags": ["t"], "sites": ["x"], "rules": {"min_alt": 1}}
    text = json.dumps(one, indent=1) + "\n" + json.dumps({**one, "label": "b", "tags": []}) + " \n"
    assert list(definitions([text, "", json.dumps({**one, "label": "c"})], str)) == ["t", "a", "b", "c"]


def test_aggregated_features_hold_their_whole_sets_and_annotations(spark, star, tmp_path):
    from triloom.plans import catalog

    spark.createDataFrame([(2, 70_000), (3, 6), (4, 5)], "o_orderkey long, o_custkey long").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    more = [(k, 7, 3, "N", "O", 1) for k in (2, 3, 4)]
    spark.createDataFrame(more, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_linenumber int").write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "steel", "b1", "name", 4)], "p_partkey long, p_type string, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["aggregate_feature_samples"](spark, star)
    assert got.columns == ["spdi", "var_type", "block", "n", "samples", "annotation", "impact", "gene_name", "gene_id", "hgvs_c", "hgvs_p"]
    known = ("steel", "HIGH", "b1", "name", "c.4N>T", "p.4T")
    assert sorted(map(tuple, got.collect())) == [
        ("chr3:8:1:?", "UNKNOWN_MISSING", 0, 1, "5", *[None] * 6),
        ("chr3:8:2:T", "INDEL", 0, 2, "5,6", *known),
        ("chr3:8:2:T", "INDEL", 1, 1, "70000", *known),
    ]
