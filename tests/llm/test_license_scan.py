import hashlib
import re
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from triloom.llm import op06_license_scan as op

MIT = op.LICENSES["MIT"]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    low = re.sub(op.COPYRIGHT_LINE, "\n", low)
    low = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+", " ", low) + " "
    for a, b in op.SPELLINGS:
        low = low.replace(a, b)
    return re.sub(" +", " ", low).strip(" ")


VARIANTS = {
    "plain": MIT,
    "shouted": MIT.upper(),
    "wrapped": MIT.replace(" ", "\n\n  "),
    "dated": "Copyright (c) 2020 Somebody <a@b.c>\n" + MIT + "\n/* All rights reserved. */\n",
    "british": MIT.replace("License", "Licence").replace("sublicense", "sub-license"),
    "quoted": MIT.replace('"', "'"),
}
OTHERS = {"half": MIT[:300], "more": MIT + " And one condition more.", "none": "Some text", "only": "Copyright 2021 X\n(c) 2022 Y", "empty": "", "null": None, "long": "word " * 40000}


def test_known_texts_in_all_spellings(spark):
    rows = [(k, v) for k, v in {**VARIANTS, **OTHERS}.items()] * 2
    docs = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(rows)], "doc_id long, text string, license_id string")
    got = {r["doc_id"]: r for r in op.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, (name, text) in enumerate(rows):
        assert got[i]["license_id"] == ("MIT" if name in VARIANTS else None), name
        assert got[i]["digest"] == hashlib.sha256(brute(text).encode()).hexdigest()
    assert op.scan(docs.limit(0)).count() == 0


def test_every_licence_is_found_and_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(op.LICENSES.values())], "doc_id long, text string")
    assert [r["license_id"] for r in op.scan(docs).orderBy("doc_id").collect()] == list(op.LICENSES)


def test_sql_agrees(spark):
    rows = [(i, t) for i, t in enumerate([*VARIANTS.values(), *OTHERS.values(), "Été ©2020 LICENCE", "a\x00b"])]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    want = sorted(c.sql(op.scan_sql()).fetchall(), key=repr)
    got = op.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "digest", "canonical_chars", "license_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_awkward_rows_and_plan(awkward):
    df = op.scan(awkward)
    assert df.count() == awkward.count() and df.where(F.col("license_id").isNotNull()).count() == 0
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_full_texts_and_usual_forms(spark):
    bsd, isc = op.LICENSES["BSD-2-Clause"], op.LICENSES["ISC"]
    folder = Path(op.__file__).parent / "licenses"
    texts = [(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "EPL-1.0", "Unlicense"} <= {n for n, _ in texts}
    texts += [
        ("GPL-3.0", dict(texts)["GPL-3.0"].split("END OF TERMS")[0]),
        ("MIT", MIT.replace("MIT License", "The MIT License (MIT)")),
        ("MIT", "Copyright Foo Bar\n" + MIT),
        ("MIT", MIT.replace("The above copyright notice", "The above\ncopyright notice").replace("MIT License", "MIT License\n\nCopyright Foo, Inc.")),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, X\n" + bsd),
        ("BSD-2-Clause", bsd.replace("1. ", "* ").replace("2. ", "* ")),
        ("ISC", "ISC License\n\n" + isc),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert [r["license_id"] for r in op.scan(docs).orderBy("doc_id").collect()] == [n for n, _ in texts]


def test_typographic_punctuation_is_punctuation(spark):
    text = op.LICENSES["MIT"]
    other = text.replace('"AS IS"', "\u201cAS\u00a0IS\u201d").replace("and/or", "and/or \u2014")
    docs = spark.createDataFrame([(1, text), (2, other), (3, other + " \u00e9t\u00e9")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in op.scan(docs).collect()} == {1: "MIT", 2: "MIT", 3: None}
