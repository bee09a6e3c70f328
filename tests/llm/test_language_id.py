import re
from collections import Counter

import numpy as np
import pytest

from triloom.llm import op04_language_id as lid


def brute(text):
    """n-grams of ' word ' for each maximal run of letters."""
    out = Counter()
    low = (text or "").lower()
    words = "".join(c if c.isalpha() else " " for c in low).split()
    for w in words:
        for c in w:
            out[c] += 1
        pad = f" {w} "
        for i in range(len(pad) - 1):
            out[pad[i : i + 2]] += 1
        for i in range(len(pad) - 2):
            out[pad[i : i + 3]] += 1
    return out


def decode(code):
    code, s = int(code), ""
    while code:
        s, code = chr(code & 0x1FFFFF) + s, code >> 21
    return s


TEXTS = ["", None, "a", "  a  b", "Été, l'été!", "12 34", "don't stop\nnow", "x" * 50, "日本語 テキスト 🙂 ok", "a1b2", ".x."]


def counted(text):
    c, n = lid.grams(text)
    return {decode(x): int(k) for x, k in zip(c, n)}


# Two neighbouring words share one blank, and bigrams of a blank are counted at each word.
@pytest.mark.parametrize("text", TEXTS)
def test_grams_match_brute_force(text):
    assert counted(text) == dict(brute(text))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_do_not_matter(monkeypatch, size):
    text = "The quick, brown fox -- jumps over 12 lazy dögs. " * 5
    want = counted(text)
    monkeypatch.setattr(lid, "_SEGMENT", size)
    assert counted(text) == want


def test_out_of_place_distance_matches_brute_force():
    profiles = {"aa": [ord(c) for c in "abcde"], "bb": [ord(c) for c in "edcba"], "cc": []}
    model = lid.Profiles(profiles, 5)
    for text in ["abcde", "eddccc", "zzz", "aabbb cc"]:
        own = sorted(brute(text).items(), key=lambda x: (-x[1], np.int64(sum(ord(c) << (21 * (len(x[0]) - 1 - i)) for i, c in enumerate(x[0])))))[:5]
        far = {}
        for name, p in profiles.items():
            rank = {chr(g): i for i, g in enumerate(p)}
            far[name] = sum(min(5, abs(rank[g] - i)) if g in rank else 5 for i, (g, _) in enumerate(own))
        best = min(far, key=lambda k: (far[k], k))
        assert model.identify(text) == (best, pytest.approx(1 - far[best] / (5 * len(own))))


def test_documents(spark):
    rows = [(i, t, lang, i) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(100, None, "en", 0), (101, "12 34 !!", "de", 0), (102, "", None, 0), (None, "the dog", None, 0), (103, "und die katze " * 5000, None, 0), (103, "und die katze", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = lid.language_of_documents(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["lang_pred"] == "en" and by[1]["lang_pred"] == "de" and by[103]["lang_pred"] == "de"
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (100, 101, 102))
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    assert lid.language_of_documents(docs.limit(0)).count() == 0


def test_nothing_learned_is_und(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert lid.language_of_documents(docs).first()["lang_pred"] == "und"


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "abc", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", lid.held_out(__import__("pyspark").sql.functions.col("doc_id")))
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.collect())
