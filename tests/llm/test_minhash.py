import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from triloom.llm import op08_minhash_dedup as op
from triloom.llm.shingles import alike, circulant, shingle_set, word_hashes


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k=5, percent=80):
    sets = [(i, shingles_of(t, k)) for i, t in rows]
    index, parent = defaultdict(list), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(index[x])
            index[x].append(n)
        for m, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                a, b = root(i), root(sets[m][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


@pytest.mark.parametrize("text", ["", None, "a", " a  B\tc\nd ", "É é x y", "x" * 3000, "a b " * 500])
def test_words_and_sets(text):
    assert len(word_hashes(text)) == len(words_of(text))
    for k in (1, 4, 5):
        assert len(shingle_set(text, k)) == len(shingles_of(text, k))


def test_word_hashes_depend_on_the_word_only(monkeypatch):
    import triloom.llm.shingles as s

    text = "one two three one TWO\tthree " * 7 + "y" * 100
    whole = word_hashes(text)
    assert len(set(whole.tolist())) == 4 and whole[0] == whole[3] and whole[1] == whole[4]
    for size in (1, 5, 64):
        monkeypatch.setattr(s, "_SEGMENT", size)
        assert (s.word_hashes(text) == whole).all()


def test_signature_is_the_least_over_turned_permutations():
    h = circulant(3, 4, 7)
    s = shingle_set("a b c d e f g h i j k", 3)
    from triloom.llm.shingles import mix

    at = (mix(s ^ h._seed) >> h._shift).astype(int)
    pi = np.concatenate([h._runs[:, 0], h._runs[:, 0]])
    assert h.signature(s).tolist() == [min(pi[a + j] for a in at) for j in range(12)]


def test_signatures_estimate_similarity():
    r = random.Random(2)
    h = circulant(6, 48)
    base = [r.randrange(10**6) for _ in range(1000)]
    for keep in (0.9, 0.5, 0.1):
        other = base[: int(keep * 1000)] + [r.randrange(10**6, 10**7) for _ in range(1000 - int(keep * 1000))]
        a, b = (np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in (base, other))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(h.signature(a) == h.signature(b)) - true) < 0.12


def test_alike_is_exact():
    a = np.arange(80, dtype=np.uint64)
    assert alike(a, np.arange(100, dtype=np.uint64), 80) and not alike(a, np.arange(101, dtype=np.uint64), 80)
    assert not alike(a[:0], a[:0], 80)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        w = [r.choice(vocabulary) for _ in range(r.choice([4, 30, 200]))]
        out.append(" ".join(w))
        for _ in range(r.randrange(6)):
            v = list(w)
            for _ in range(r.randrange(1, 8)):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            out.append(" ".join(v) if r.random() < 0.8 else " ".join(v).upper())
    r.shuffle(out)
    return list(enumerate(out))


def test_matches_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op.near_duplicates(docs, words=4)) == brute(rows, 4)


def test_small_blocks_change_nothing(spark, monkeypatch):
    """Many variants of one text: a large bucket that is not one component, over several blocks."""
    monkeypatch.setattr(op, "BLOCK", 4)
    monkeypatch.setattr(op, "UNIT", 3)
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        v = list(base)
        for _ in range(r.randrange(1, 7)):
            v[r.randrange(60)] = f"z{r.randrange(9)}"
        rows.append((i, " ".join(v)))
    want = brute(rows, 4)
    assert 1 < len({x[2] for x in want}) < 60
    assert found(op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == want


def hot_group(n, seed=6):
    """n edits of one text: most link to the others, one in eight is edited beyond that."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(n):
        v = list(base)
        at = r.randrange(60)
        for k in range(at, at + (18 if i % 8 == 3 else 2)):
            v[k] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    return rows


def test_rows_of_a_hot_group_grow_in_proportion(spark, monkeypatch):
    """Rows of the units of the full comparison against entries of the buckets, at two sizes of one group of near copies."""
    monkeypatch.setattr(op, "BLOCK", 8)
    sent, cut = {}, op.Scratch.cut

    def counted(self, df, name="t"):
        out = cut(self, df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(op.Scratch, "cut", counted)
    for n in (200, 600):
        rows = hot_group(n)
        assert found(op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == brute(rows, 4)
        assert 0 < sent["wide"] <= sent["buckets"] and sent["units"] <= sent["wide"]


def test_common_counts_in_slices():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype("u8") for _ in range(20)]
    left, right = np.arange(5), np.arange(3, 20)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    for width in (1, 7, 4096):
        assert op.common_counts(sets, left, right, width).tolist() == want


def test_awkward_rows(awkward):
    got = op.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and not by[2]["kept"]
    for i in (3, 4, 7):
        assert (by[i]["n_shingles"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert by[5]["n_shingles"] == 1 and by[6]["n_shingles"] == 1
    assert found(op.near_duplicates(awkward.limit(0))) == []


def test_all_texts_of_a_repeated_id_are_linked(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(5, a), (5, b), (8, a + " more"), (9, b + " more")]
    got = found(op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and {r[2] for r in got} == {5}
