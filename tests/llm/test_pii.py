import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triloom.llm import op12_pii as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(number)))
    return total % 10 == 0


def base(text):
    """(kind, start, end, value, before, after) by the contract's patterns as they stand."""
    out = []
    for kind, pattern in PLAIN.items():
        found = [(m.start(), m.end(), m[0], re.sub("[^0-9]", "", m[0])) for m in re.finditer(pattern, text)]
        if kind == "card":
            found = [f for f in found if 13 <= len(f[3]) <= 19]
        ends = [0, *[f[1] for f in found]]
        starts = [*[f[0] for f in found], len(text)]
        for i, (s, e, m, number) in enumerate(found):
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.split(".")), "card": luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if good:
                value = {"email": m.translate(LOWER), "ip": m}.get(kind, number)
                out.append((kind, s, e, f"{kind}:{value}", text[ends[i] : s], text[e : starts[i + 1]]))
    return out


def is_term(w):
    return op.SHORTEST <= len(w) <= op.LONGEST_TERM and re.search("[^0-9]", w)


def near(piece, left):
    words = re.split(op.GAPS, (piece[-op.REACH :] if left else piece[: op.REACH]).translate(LOWER))
    if len(piece) > op.REACH:
        words = words[1:] if left else words[:-1]
    words = [w for w in words if is_term(w)]
    return words[-op.NEAR :] if left else words[: op.NEAR]


def brute(rows):
    texts = [(i, t or "") for i, t in rows]
    n = len(texts)
    d, f, t = Counter(), Counter(), Counter()
    for _, text in texts:
        found = base(text)
        d.update({e[3] for e in found})
        pairs = {(e[3], w) for e in found for w in near(e[4], True) + near(e[5], False)}
        f.update(pairs | {(c, w[: op.PREFIX] + "*") for c, w in pairs if len(w) > op.PREFIX})
        words = set(re.split(op.GAPS, text.translate(LOWER)))
        t.update(words | {w[: op.PREFIX] + "*" for w in words if len(w) > op.PREFIX and is_term(w)})
    told = {w for (c, w), k in f.items() if k >= op.SUPPORT and math.log2(n * k / (d[c] * t[w])) >= op.LEAST_BITS - 1e-12 and math.log2(t[w] / k) <= op.RESIDUE}
    out, clean = [], []
    for i, text in texts:
        found = [e[:3] for e in base(text)]
        more = [("term", m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)) if m[0] in told]
        more = [m for m in more if not any(e[1] < m[2] and m[1] < e[2] for e in found)]
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(e[0] == k for e in found) for k in PLAIN]
        out.append((i, *counts, len(more), hashlib.sha256(line(found).encode()).hexdigest(), line(found + more)))
        at, new = 0, ""
        for k, s, e in sorted(found + more, key=lambda x: x[1:]):
            w = text[s:e].translate(LOWER)
            label = f"[{k}]" if k != "term" or len(w) <= op.PREFIX or w[: op.PREFIX] + "*" in told else w[: op.PREFIX] + "*"
            new += text[at : max(at, s)] + (label if s >= at else "")
            at = max(at, e)
        clean.append((i, new + text[at:], len(found + more)))
    return sorted(out, key=repr), sorted(clean, key=repr)


def found(df):
    return sorted((tuple(r) for r in op.personal_data(df).collect()), key=repr)


def cleaned(df):
    return sorted((tuple(r) for r in op.sanitised(df).collect()), key=repr)


def cases():
    r = random.Random(7)
    card = lambda: next(c for c in iter(lambda: "".join(r.choice("0123456789") for _ in range(16)), "") if luhn(c))
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "and", "of", "Ünï"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = []
    for i in range(700):
        text = prose(r.randrange(5, 90))
        if i > 120:
            out.append((i, text))
            continue
        if i % 6 == 0:
            text += f" write to Jonathan Zweistein: {'J.Zwei@Mail.example.com' if i % 12 else 'j.zwei@mail.EXAMPLE.com'} or call. " + prose(20)
        if i % 10 == 0:
            text += f" the host Quasar answers at 10.0.0.{i % 3} today"
        if i % 15 == 0:
            text = f"pay {card()} now, {card()[:4]} {card()} " + text + f" +49 (30) 12{i}345-6 +1 2"
        if i in (7, 8):
            text += " Zweistein was here without an address"
        out.append((i, text))
    return out


def test_corpus_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect, clean = brute(rows)
    assert sum(r[5] for r in expect) > 40 and [r[5] for r in expect if r[0] in (7, 8)] != [0, 0]
    assert found(df) == expect
    assert cleaned(df) == clean
    assert any("zwe*" in t or "[term]" in t for _, t, _ in clean)


EDGES = [
    "a@b.c", "a@b", "@b.c", "x a@b.c@d.e%y@f.g", "..%@a-b.c..d", "é@b.c", "a@b.c_d", "a@b..c", "1.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5.6.7.8", "01.002.0003.0255", "0.0.0.0", "99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111112", "0000000000000", "00000000000000000000", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x4111111111111111x", "4111111111111111 ", "-4111111111111111-",
    "1.4111111111111111.2", "1 4111111111111111", "+1 202 555 0171", "+1", "+12", "+1-2", "+49 (0) 30 1234-567", "+(1)2345678901", "++1 2345678901", "+1 234 567 8901 +44 20 7946 0958", "+1 2345678901234567890", "+1 (((((", "+1 2345678 901()",
    "🙂 a@b.c 🙂 1.2.3.4 日本 +1 2345 678901", "A@B.C\n\ta@b.c", "１.2.3.4", "", " ", "a" * 20_000, "1" * 20_000, "a." * 10_000, "1." * 10_000, "1 " * 10_000, "a@b" + ".c" * 10_000, "+1" + "(" * 20_000, "+" * 20_000, "a@" * 10_000, "0" * 20_000 + ".1.1.1",
    "a@b.c " * 3000,
]


def test_patterns_against_plain_ones(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string").select("doc_id", op.entities(F.col("text")).alias("e"))
    for row in df.collect():
        assert [(e["kind"], e["start"], e["end"], f"{e['kind']}:{e['value']}") for e in row["e"]] == [e[:4] for e in base(EDGES[row["doc_id"]])], EDGES[row["doc_id"]][:60]


def test_random_strings_against_plain_patterns(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(r.choice(["0123456789 -.", "+0123456789() -.", "ab@.-%", "1.25 a@+"])) for _ in range(r.randrange(120)))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", op.entities(F.col("text")).alias("e"))
    for row in df.collect():
        assert [(e["kind"], e["start"], e["end"]) for e in row["e"]] == [e[:3] for e in base(rows[row["doc_id"]][1])], rows[row["doc_id"]][1]


def test_awkward_rows(spark, awkward):
    assert found(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])[0]
    assert found(awkward.limit(0)) == []
    rows = [(1, "mail Zed at zed@x.org now")] * 3 + [(None, "mail Zed at zed@x.org now"), (None, None), (2, "Zed again")] + [(i, "none here") for i in range(3, 40)]
    df = spark.createDataFrame([(*r, 1, "x", []) for r in rows], "doc_id long, text string, key int, entities string, terms array<int>")
    assert found(df) == brute(rows)[0]
    assert cleaned(df) == brute(rows)[1]


def test_one_hot_entity_and_copies(spark):
    rows = [(i, f"Contact Support Desk: help@example.com thanks {i}") for i in range(300)] + [(300 + i, "Ring Marvin on +1 202 555 0171 please") for i in range(20)] + [(400 + i, f"nothing {i}") for i in range(300)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)[0]
    by_id = {r[0]: r for r in got}
    assert by_id[0][5] == 0 and by_id[300][5] > 0 and by_id[400][-1] == ""  # a common entity is told by no word


def test_no_python_in_the_plan(awkward):
    assert not re.search("Python|Pandas|Arrow", op.personal_data(awkward)._jdf.queryExecution().toString())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 26, 400])
def test_places_of_matches(spark, n):
    text = "".join(f"{'é' * (i % 4)}<{'x' * (i % 5 + 1)}>" for i in range(n)) + "tail"
    got = spark.createDataFrame([(text,)], "text string").select(op.matches(F.col("text"), F.lit("x+")).alias("m")).first()["m"]
    assert [(m["found"], m["start"], m["end"]) for m in got] == [(m[0], m.start(), m.end()) for m in re.finditer("x+", text)]
