import hashlib
import random
import re

import pytest

from triloom.llm import op03_exact_dedup as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in op.duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_awkward_rows(awkward):
    assert found(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_empty_table(awkward):
    assert found(awkward.limit(0)) == []


def test_random_texts_with_shared_passages(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "delta\n", "É"]
    base = [" ".join(r.choice(words) for _ in range(r.choice([3, 400, 3000]))) for _ in range(12)]
    texts = base + [base[0].upper(), base[1], base[2] + "!", base[3] + base[4], base[4] + base[3], base[5].swapcase()]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_chunks_make_up_the_text_and_share_passages(spark):
    r = random.Random(9)
    words = ["one", "two.", "three", "four", "five\n"] * 8 + ["phase"]
    long = " ".join(r.choice(words) for _ in range(20000))
    rows = [(1, long), (2, "An insertion at the front. " + long), (3, "y" * 50000), (4, "")]
    from pyspark.sql import functions as F

    got = {x["doc_id"]: x["c"] for x in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", op.chunks(F.col("text")).alias("c")).collect()}
    for i, t in rows:
        assert "".join(got[i]) == t and all(len(c) <= 8193 for c in got[i])
        assert got[i] == [m[0] for m in re.finditer(op.CHUNK.replace(r"\z", r"\Z").replace("(?s)", ""), t, re.S)]
    assert len(set(got[1]) & set(got[2])) > len(got[1]) * 0.9


@pytest.mark.parametrize("first,last", [(0x430, 0x44F), (0x4E00, 0x9FA0), (0x3041, 0x3096), (0x621, 0x64A), (0x61, 0x7A)])
def test_scripts_share_chunks_of_shared_passages(spark, first, last):
    """Cyrillic, CJK, kana, Arabic and Latin: a passage behind other words is cut as it is at the front."""
    from pyspark.sql import functions as F

    r = random.Random(first)
    words = ["".join(chr(r.randint(first, last)) for _ in range(r.randint(2, 7))) for _ in range(3000)]
    long = " ".join(r.choice(words) for _ in range(12000))
    rows = [(1, long), (2, " ".join(r.choice(words) for _ in range(37)) + " " + long)]
    got = [set(x["c"]) for x in spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id").select(op.chunks(F.col("text")).alias("c")).collect()]
    assert len(got[0] & got[1]) > 0.8 * len(got[0]) and len(got[0]) > 20
    assert b"".join(c.encode("latin-1") for c in spark.createDataFrame(rows, "doc_id long, text string").where("doc_id = 1").select(op.chunks(F.col("text")).alias("c")).first()["c"]).decode() == long


def test_ambiguous_identifiers_are_told_apart(spark, monkeypatch):
    """With an identifier that all chunks share, contents still decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(op.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c" * 3000), (5, "d" * 3000), (6, "C" * 3000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("n", [1, 50])
def test_one_hot_group(spark, n):
    rows = [(i, "same text") for i in range(n)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_no_python_in_the_plan(awkward):
    plan = op.duplicates(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
