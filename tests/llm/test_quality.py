import math
import random
import re

import numpy as np
import pytest

from triloom.llm import op01_quality as op


def test_gradient_matches_differences():
    r = np.random.default_rng(0)
    m = op.AttentionMIL(hidden=5, gate=3)
    x, first, y = r.normal(size=(9, op.WIDTH)) * 0.2, np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m._forward(x, first)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = m._gradient(x, first, y)
    for k, v in m.p.items():
        for i in list(np.ndindex(v.shape))[:: max(1, v.size // 7)]:
            old = v[i]
            v[i] = old + 1e-5
            up = loss()
            v[i] = old - 1e-5
            down = loss()
            v[i] = old
            assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_cover_the_whole_text():
    text = "one two three. " * 500
    x = op.passages(text)
    assert x.shape == (-(-1500 // op.WORDS), op.WIDTH)
    assert not np.array_equal(op.passages(text + "LATE!! CHANGE!!")[-1], x[-1])
    assert len(op.passages("z" * 10000)) == 3
    for empty in (None, "", " \n"):
        assert op.passages(empty).shape == (1, op.WIDTH) and not op.passages(empty).any()


def brute_features(text):
    """Each passage's features by loops over its bytes and words."""
    data, marks = text.encode(), ".,;:!?'\"-_()[]{}<>|*#$%&/@+=\\"
    words, at = [], 0  # (start, word)
    for w in re.split(rb"([ \t-\r]+)", data):
        if w and w[0] not in b" \t\n\x0b\x0c\r":
            words.append((at, w.lower()))
        at += len(w)
    cuts = [0, *(words[i][0] for i in range(op.WORDS, len(words), op.WORDS))]
    bounds = []
    for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
        bounds += [(x, min(b, x + op.BYTES)) for x in range(a, b, op.BYTES)]

    def kind(c):
        ch = chr(c)
        if c == 10:
            return 6
        if c in b" \t\x0b\x0c\r":
            return 0
        if ch in marks and c < 128:
            return 7 + marks.index(ch)
        return 5 if c >= 128 else 2 if ch.islower() else 3 if ch.isupper() else 4 if ch.isdigit() else 1

    out = []
    for a, b in bounds:
        one, two = [0.0] * 37, [0.0] * 64
        for i in range(a, b):
            one[kind(data[i])] += 1 / (b - a)
            if i:
                pair = kind(data[i - 1]) * 37 + kind(data[i])
                two[(pair * 2654435761 % 2**32 >> 16) % 64] += 1 / (b - a)
        own = [w for s, w in words if a <= s < b]
        n = max(1, len(own))
        more = [sum(x == y for x, y in zip(own, own[1:], strict=False)) / n, len(set(own)) / n, min((b - a) / n, 50) / 10]
        more += [min(data[a:b].count(10) / n, 1), min(len(own), op.WORDS) / op.WORDS, min(1.0, len(words) / 2000)]
        out.append([math.sqrt(x) for x in one + two] + more)
    return out


MIXED = ["One two, two THREE (4)! Été\n" * 90, "a b c", "x" * 9000 + " end " * 70, "\n\n lead and trail \n"]


@pytest.mark.parametrize("segment", [1, 700, 1 << 20])
@pytest.mark.parametrize("text", MIXED)
def test_features_match_loops_in_any_segments(monkeypatch, text, segment):
    monkeypatch.setattr(op, "SEGMENT", segment)
    assert op.passages(text) == pytest.approx(np.array(brute_features(text)), abs=1e-6)


def test_score_matches_loops(spark):
    m, r = op.AttentionMIL(), np.random.default_rng(8)
    m.mean, m.scale = r.normal(size=op.WIDTH) * 0.1, 1 + r.random(op.WIDTH)
    p = {k: v.tolist() for k, v in m.p.items()}

    def squash(x):
        return 1 / (1 + math.exp(-x))

    def dot(v, matrix, j):
        return sum(a * row[j] for a, row in zip(v, matrix, strict=True))

    def brute(text):
        bag, weights = [], []
        for f in brute_features(text):
            x = [(a - b) / c for a, b, c in zip(f, m.mean, m.scale, strict=True)]
            h = [math.tanh(dot(x, p["E"], j) + p["e"][j]) for j in range(24)]
            gate = [math.tanh(dot(h, p["V"], j)) * squash(dot(h, p["U"], j)) for j in range(12)]
            bag.append(h)
            weights.append(math.exp(sum(a * b for a, b in zip(gate, p["w"], strict=True))))
        z = [sum(w * h[j] for w, h in zip(weights, bag, strict=True)) / sum(weights) for j in range(24)]
        return squash(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["b"][0])

    docs = spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in op.score(docs, m).collect()}
    assert got == pytest.approx({i: brute(t) for i, t in enumerate(MIXED)}, abs=1e-5)


def test_every_passage_of_a_long_document_is_fitted_on(spark):
    """Labels rest on one passage of 200, at any place."""
    rows = []
    for i in range(120):
        words = ["good words here now"] * 3200
        if i % 2:
            words[(i * 26) % 3200] = "BUY!! NOW!! " * 40
        rows.append((i, " ".join(words), 1 - i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = op.bags(docs.join(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"), "doc_id"))
    assert {r["rows"] for r in held.select("rows").collect()} <= set(range(200, 203))
    model = op.fit(held)
    got = op.score(docs, model).collect()
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in got]) > 0.97


def test_memory_of_a_long_text_is_a_few_times_its_size():
    import tracemalloc

    text = "some words of text, again. " * 400_000  # 10.8 MB
    tracemalloc.start()
    x = op.passages(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == -(-2_000_000 // op.WORDS) and peak < 16 * len(text)


def sample(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        good = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(64)) for _ in range(r.randrange(1, 6))]
        bad = i % 3 == 0
        if bad:  # one bad passage among good ones decides
            good[r.randrange(len(good))] = "BUY!! NOW!! " * 32
        out.append((i, " ".join(good), 0 if bad else 1))
    return out


def test_one_bad_passage_decides_on_held_out_documents(spark):
    rows = sample(600, 1)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, score string, held_out int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (5, 7), (99999, 0)], "doc_id long, quality int")
    got = op.quality_of_documents(docs, labels).collect()
    assert len(got) == 600
    truth = dict((i, q) for i, _, q in rows)
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    again = {r["doc_id"]: r["score"] for r in op.quality_of_documents(docs, labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)


def test_awkward_rows_and_no_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op.quality_of_documents(awkward, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert op.quality_of_documents(awkward, labels).count() == awkward.count()
    assert op.quality_of_documents(awkward.limit(0), labels).count() == 0
    kept = op.score(awkward, None)
    assert {*kept.columns} == {*awkward.columns, "predicted"}
