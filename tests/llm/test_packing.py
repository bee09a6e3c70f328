import random
import zlib

import numpy as np
import pytest

from triloom.llm import op09_packing as op


def best_fit(lengths, room):
    """Best-fit decreasing, one document at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in range(len(gaps)) if gaps[g] >= n]
        if fit:
            g = min(fit, key=lambda g: gaps[g])
            gaps[g] -= n
        else:
            gaps.append(room - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_are_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randrange(1, 65), r.randrange(1, 8), 64]) for _ in range(r.randrange(300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    matches, sequences = op.sweeps(counts, 64)
    assert sequences == best_fit(lengths, 64)
    used = {}
    for length, lo, hi, first, each, offset in matches:
        for rank in range(lo, hi):
            used.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert sum(map(len, used.values())) == len(lengths)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for n in counts:
        assert sorted(x for m in matches if m[0] == n for x in range(m[1], m[2])) == list(range(counts[n]))


def test_cuts():
    assert op.cuts(5, 4) == [(0, 1), (1, 4)] and op.cuts(8, 4) == [(0, 4), (4, 4)] and op.cuts(3, 4) == [(0, 3)]


def test_ids_are_those_of_the_public_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    letters = "abc XYZ é日🙂\t\n  '’s 12,.!|<>endoftext"
    texts = ["", "Hello  world!\n\n", "<|endoftext|> it's", *("".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(200))]
    for text in texts:
        assert op.token_ids(text, added=True).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 1_200_000 + "<|endoftext|>", "x <|endoftext|> " + " " * 1_000_000])
def test_long_runs_of_blanks(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert op.token_ids(text, added=True).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_a_blank_text_beyond_the_fast_encoder_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_100_000), (2, "a b")], "doc_id long, text string")
    rows = op.pack_documents(docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(op.token_ids(" " * 1_100_000)) and {r["doc_id"] for r in rows} == {1, 2}


def check(rows, texts, room):
    """Whole, in order, gapless, and the digests are right."""
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append(op.token_ids(t))
    place = {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for parts in place.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)]).tolist()[:-1] and sum(n for _, n in parts) <= room
    return len(place)


def test_documents(spark):
    r = random.Random(1)
    texts = [(i, "tok " * r.choice([1, 3, 10, 40, 90])) for i in range(120)]
    rows = op.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), room=32).collect()
    n = check(rows, texts, 32)
    assert n == best_fit([r["length"] for r in rows], 32)
    for i, _ in texts:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)]).tolist()[:-1]
        assert all(r["length"] == 32 for r in own[1:])


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(20)], "doc_id long, text string")
    packed = op.pack_documents(docs, room=64, with_ids=True)
    seqs = {r["sequence_id"]: r["ids"] for r in op.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_awkward_rows(awkward):
    rows = op.pack_documents(awkward).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()], 1024)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (3, 4)) == [1, 1]
    assert op.pack_documents(awkward.limit(0)).count() == 0


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        op.pack(spark.createDataFrame([(5,)], "length long"), room=4)


def test_documents_get_the_ids_of_the_tokenizer_at_its_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x\n <|endoftext|>\n\n y", "<|endoftext", "é  <|endoftext|>'s"]
    rows = op.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
