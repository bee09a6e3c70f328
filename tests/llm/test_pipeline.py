import random

import corpus_pipeline
import pytest


from tests.llm.test_minhash import brute as near_groups
from triloom.llm import op04_language_id, op09_packing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    words = {"en": "the and of with that from this house river stone".split(), "de": "der und die nicht mit auch haus fluss stein über".split()}
    rows = []
    for i in range(150):
        lang = "en" if i % 3 else "de"
        rows.append((" ".join(r.choice(words[lang]) for _ in range(r.choice([30, 80]))), lang))
    rows += [(rows[i][0].upper(), rows[i][1]) for i in range(10)]
    for i in range(20, 30):
        w = rows[i][0].split(" ")
        w[-1] = "changed"
        rows.append((" ".join(w), rows[i][1]))
    rows += [("12 34 !!", "en"), ("", "en"), (None, None), ("日本語日本語日本語", None)]
    d = tmp_path_factory.mktemp("sf")
    table = [(i, t, lang, f"s{i % 4}", len(t or "")) for i, (t, lang) in enumerate(rows)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    return str(d)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "minhash_near_dedup", "mix_sources", "pack"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = stages["language_id"](spark, docs, folder)
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, t in text.items() if t and any(c.isalpha() and c < "ÿ" for c in t)}

    last = {}
    for i in sorted(ids):
        last[text[i].translate(LOWER)] = i
    unique = stages["exact_dedup"](spark, kept, folder)
    assert unique.columns == COLUMNS and sorted(r["doc_id"] for r in unique.collect()) == sorted(last.values())

    left = stages["minhash_near_dedup"](spark, unique, folder)
    want = [r[0] for r in near_groups([(i, text[i]) for i in sorted(last.values())], 5) if r[3]]
    assert left.columns == COLUMNS and sorted(r["doc_id"] for r in left.collect()) == want and len(want) < len(last)

    mixed = stages["mix_sources"](spark, left, folder)
    assert mixed.columns == COLUMNS
    took = [(r["doc_id"], len(r["text"].split()), r["source"]) for r in mixed.collect()]
    total = sum(len(text[i].split()) for i in want)
    for n, share in enumerate((1, 2, 3, 1)):
        assert abs(sum(s for _, s, src in took if src == f"s{n}") - total * share / 7) < 80

    packed = stages["pack"](spark, mixed, folder).collect()
    assert sum(r["length"] for r in packed) == sum(len(op09_packing.token_ids(text[i])) for i, _, _ in took)


def test_run_is_the_stages_in_order(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_awkward_rows_survive_or_go_without_a_crash(spark, awkward, tmp_path):
    docs, given = awkward, {tuple(r) for r in awkward.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == awkward.columns and {tuple(r) for r in docs.collect()} <= given
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), "").count() == 0


def test_registered_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_dedup_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcd")
    rows = [(5, a), (5, b), (9, b.upper()), (7, c), (7, c), (None, d), (None, d), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.exact_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, a), (9, b.upper()), (7, c), (None, d)], key=str)

    near = [(5, a), (5, b), (9, b + " more"), (7, c), (7, c), (None, d), (None, d + " more"), (None, c + " more")]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    left = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(5, "a"), (5, "b"), (7, "c"), (None, "d")], key=str)


def test_mix_counts_rows_of_a_repeated_id_by_themselves(spark):
    rows = [(i % 5, " ".join(["w"] * (10 + i % 7)), "abc"[i % 3]) for i in range(300)] + [(None, "w w", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    for source, share in zip("abc", (1, 2, 3), strict=True):
        assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == source) - total * share / 6) < 20


def test_short_texts_of_a_language_with_many_letters_stay(spark):
    r = random.Random(5)
    signs, weights = [chr(0x4E00 + i) for i in range(1500)], [1 / (i + 9) for i in range(1500)]
    rows = [(i, "".join(r.choices(signs, weights, k=30)), "zh") for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, "123 !", "zh"), (301, "ααα βββ", None)], "doc_id long, text string, lang string")
    learning = docs.where(~op04_language_id.held_out(docs["doc_id"]))
    scores = [x["score"] for x in op04_language_id.identify(docs.where("doc_id < 300"), op04_language_id.learn(learning)).collect()]
    assert 0 < min(scores) < 0.2
    assert sorted(x["doc_id"] for x in corpus_pipeline.language_id(spark, docs, "").collect()) == list(range(300))
