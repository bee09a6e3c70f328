import random
import re
from collections import Counter

import numpy as np
import pytest

from triloom.llm import op11_phrases as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    c = f.setdefault(lang, Counter())
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        lost = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if cand[p[i : i + k]] <= a}
        scored = []
        for p, a in cand.items():
            if p not in lost:
                s, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df, **named):
    return sorted(tuple(r) for r in op.collocations(df, **named).collect())


def corpus(n, seed, words=12):
    r = random.Random(seed)
    vocabulary = ["The", "a", "Ünïcode", "x-1", "|", "日本", "don't", *[f"w{i}" for i in range(words)]]
    out = []
    for _ in range(n):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ", " new york "]) for _ in range(r.randrange(60)))
        out.append((r.choice(["en", "en", "de", None]), text))
    return out


@pytest.mark.parametrize("longest,least,top", [(5, 3, 1000), (4, 10, 7), (2, 5, None)])
def test_against_brute_force(spark, longest, least, top):
    rows = corpus(150, longest)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, longest=longest, least=least, top=top) == brute(rows, longest, least, top)


def test_shards_and_segments_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 40)
    monkeypatch.setattr(op, "SEGMENT", 30)
    monkeypatch.setattr(op, "BATCH", 64)
    monkeypatch.setattr(op, "LEAST_PLACES", 1 << 15)
    monkeypatch.setattr(op, "MOST_PLACES", 1 << 15)
    rows = corpus(60, 9, 3) + [("en", "one two three four five six " * 60)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert found(df, least=2, top=None) == brute(rows, 5, 2, None)


def test_shift_and_count_across_blocks():
    stream = np.array([0, 1] * 30 + [-1] + [0, 1, 0], np.int64)
    maps = op.Bitmaps(stream, 0, np.array([0, 1]))
    first, second, block, bits = maps.pairs()
    count = Counter()
    for a, b, n in zip(first.tolist(), second.tolist(), np.bitwise_count(bits).tolist()):
        count[a, b] += n
    assert count == {(0, 1): 31, (1, 0): 30}
    got = {tuple(map(int, i)): int(n) for ids, c in maps.phrases(lambda a, b: a != b, 4) for i, n in zip(ids, c)}
    assert got == {(0, 1): 31, (1, 0): 30, (0, 1, 0): 30, (1, 0, 1): 29, (0, 1, 0, 1): 29, (1, 0, 1, 0): 28}


def test_segments_make_up_the_text():
    for text in ("", "a" * 3_000_000, "ab cd. " * 200_000):
        parts = list(op.segments(text))
        assert "".join(parts) == text and all(len(p) < 2 * op.SEGMENT or " " not in p for p in parts)


def test_awkward_rows(awkward):
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert found(awkward, least=2, top=50) == brute(rows, 5, 2, 50)
    assert found(awkward.limit(0)) == []


def test_ties_and_one_hot_phrase(spark):
    rows = [("en", "b a. a b. c d. d c")] * 5 + [("en", "is onhe " * 400)] * 20 + [("und", "q r")] * 3 + [(None, "q r")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, least=5, top=100) == brute(rows, 5, 5, 100)


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 10**13
    freq = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, big), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 97 * big)], "lang string, n long")
    monkeypatch.setattr(op, "frequent_phrases", lambda *a: (freq, totals))
    assert found(freq.select("lang", "phrase")) == [("en", 1, "a b", big - 7, 3 * big, big, 97 * big, 1000 * (big - 7) * 97 * big // (3 * big * big))]


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    rows = corpus(80, 4)
    monkeypatch.setattr(op.Likely, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert found(spark.createDataFrame(rows, "lang string, text string"), least=4, top=None) == brute(rows, 5, 4, None)


def test_bitmap_has_what_it_was_made_of(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    likely = op.Likely.of(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    assert likely.has(hashes).all() and likely.has(hashes + 1).mean() < 0.05


def test_phrases_that_are_not_kept_are_not_extended():
    stream = np.array([0, 1, 2, 3, -1] * 20 + [1, 2, 3, 0], np.int64)
    maps = op.Bitmaps(stream, 0, np.arange(4))
    kept = lambda ids: (ids[:, -3:] == [1, 2, 3]).all(axis=1)
    got = {tuple(map(int, i)): int(n) for ids, c in maps.phrases(lambda a, b: a >= 0, 4, kept) for i, n in zip(ids, c)}
    assert got == {(0, 1): 20, (1, 2): 21, (2, 3): 21, (3, 0): 1, (1, 2, 3): 21}


def test_hash_of_a_pair_is_one_of_a_phrase():
    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, (100, 2))
    assert (op.phrase_hash(hashes) == op.pair_hash(hashes[:, 0], hashes[:, 1])).all()
