import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triloom.operators import cluster, kmer, tree

# A tree and its distances.
TEXT = "(genome:0,SampleA:2,(SampleB:1,SampleC:1):1);"


def names(spark, *x):
    return spark.createDataFrame([(n,) for n in x], "name string")


def test_newick_round_trip():
    for text in (TEXT, "((a:1,b:2)x:3,'c d':0.5,e:1e-06);", "a;"):
        once = tree.to_newick(tree.parse_newick(text))
        assert tree.to_newick(tree.parse_newick(once)) == once
    assert tree.to_newick(tree.parse_newick(TEXT)) == TEXT
    with pytest.raises(ValueError):
        tree.parse_newick("((a,b);")


def test_cluster_scores(spark):
    nodes = tree.tree_nodes(spark, tree.parse_newick("(SampleA:2,(SampleB:1,SampleC:1):1);"))
    groups = spark.createDataFrame([("bc", "SampleB"), ("bc", "SampleC"), ("ab", "SampleA"), ("ab", "SampleB"), ("none", "x")], "group string, name string")
    got = {r["group"]: r["score"] for r in cluster.mrca_jaccard(nodes, groups).collect()}
    assert got["bc"] == 1 and got["ab"] == pytest.approx(2 / 3) and got["none"] != got["none"]
    with pytest.raises(ValueError):
        cluster.register_score_kind("mrca_jaccard", None)


def test_distances_and_mrca(spark):
    nodes = tree.tree_nodes(spark, tree.parse_newick(TEXT))
    d = {(r["anchor"], r["name"]): r["distance"] for r in tree.distances(nodes, names(spark, "SampleA", "SampleB")).collect()}
    assert d[("SampleB", "SampleC")] == 2 and d[("SampleB", "SampleA")] == 4 and d[("SampleA", "SampleA")] == 0 and d[("SampleA", "genome")] == 2
    top = tree.mrca(nodes, names(spark, "SampleB", "SampleC"))
    assert {r["name"] for r in tree.leaves_below(nodes, top).collect()} == {"SampleB", "SampleC"}
    assert tree.mrca(nodes, names(spark, "x")).count() == 0
    assert {r["name"] for r in tree.leaves_below(nodes, tree.mrca(nodes, names(spark, "SampleA"))).collect()} == {"SampleA"}


def test_reshaping():
    t = tree.parse_newick(TEXT)
    assert tree.to_newick(tree.prune(tree.parse_newick(TEXT), {"SampleA", "SampleB"})) == "(SampleA:2,SampleB:2);"
    assert tree.prune(tree.parse_newick(TEXT), set()) is None
    out = tree.set_outgroup(t, "SampleA")
    assert out.children[0].name == "SampleA" and sorted(out.leaf_names()) == ["SampleA", "SampleB", "SampleC", "genome"]
    assert sorted(tree.relabel(t, str.upper).leaf_names())[0] == "GENOME"


def path_lengths(root):
    parent, dist, leaves = {}, {id(root): 0.0}, {}
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n.children:
            parent[id(c)], dist[id(c)] = n, dist[id(n)] + c.length
            todo.append(c)
        if not n.children:
            leaves[n.name] = n

    def up(n):
        out = [id(n)]
        while id(n) in parent:
            n = parent[id(n)]
            out.append(id(n))
        return out

    return {(a, b): dist[id(x)] + dist[id(y)] - 2 * max(dist[k] for k in set(up(x)) & set(up(y))) for a, x in leaves.items() for b, y in leaves.items()}


def test_neighbour_joining_recovers_an_additive_matrix():
    true = path_lengths(tree.parse_newick("((a:1,b:2):1.5,(c:3,d:1):0.5,e:2);"))
    labels = sorted({a for a, _ in true})
    m = np.array([[true[(a, b)] for b in labels] for a in labels])
    got = path_lengths(tree.neighbour_joining(labels, m))
    assert all(got[k] == pytest.approx(v) for k, v in true.items())


def test_single_linkage_heights():
    m = np.array([[0, 0.522, 0.5], [0.522, 0, 0.3186], [0.5, 0.3186, 0]])
    d = path_lengths(tree.single_linkage(["A", "B", "C"], m))
    assert d[("B", "C")] == pytest.approx(0.3186) and d[("A", "B")] == pytest.approx(0.5) == d[("A", "C")]
    assert tree.single_linkage(["x"], np.zeros((1, 1))).name == "x"


def test_kmer_within_and_matrix(spark):
    sets = {1: range(10), 2: range(5, 15), 3: range(100, 110), 4: range(10)}
    s = spark.createDataFrame([(i, 31, h) for i, hs in sets.items() for h in hs], "sample_id long, ksize int, hash long")
    ids, m = kmer.distance_matrix(s, s)
    jac = lambda a, b: 1 - len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    assert all(m[i, j] == pytest.approx(jac(a, b)) for i, a in enumerate(ids) for j, b in enumerate(ids))
    one = spark.createDataFrame([(1,)], "sample_id long")
    assert {r[0] for r in kmer.within(s, one, 0.67).collect()} == {1, 2, 4}
    assert {r[0] for r in kmer.within(s, one, 0.5).collect()} == {1, 4}
    with pytest.raises(ValueError):
        kmer.distance_matrix(s, spark.createDataFrame([(1,), (9,)], "sample_id long"))


def test_canonical_kmers(spark):
    from triloom.functions.hashing import canonical_kmer_hashes

    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    s = "ACGTTGCATTAGCCGATAGGCTTAACGGATCCA" * 3
    assert sorted(canonical_kmer_hashes(s, 21)) == sorted(canonical_kmer_hashes(back(s), 21))
    assert len(canonical_kmer_hashes("ACGTN" + "ACGTA", 5)) == 1 and len(canonical_kmer_hashes("AC", 5)) == 0
    t = spark.createDataFrame([(1, s), (2, back(s)), (3, None)], "sample_id long, bases string")
    got = {}
    for r in kmer.dna_sketch(t, 21, 1).collect():
        got.setdefault(r["sample_id"], set()).add(r["hash"])
    assert got[1] == got[2] and 3 not in got


def test_hashes_are_those_of_signature_files():
    from triloom.functions.hashing import canonical_kmer_hashes, most, murmur3

    # Fixed value: the published hash of a k-mer.
    assert murmur3(np.frombuffer(b"ACG", np.uint8)[None, :]).tolist() == [1731421407650554201]

    def plain(data, seed=42):
        """The same hash, a row at a time."""
        mask, turn = 2**64 - 1, lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1)
        c1, c2, h1, h2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed, seed
        word = lambda b: int.from_bytes(b, "little")
        whole = len(data) // 16 * 16
        for i in range(0, whole, 16):
            h1 ^= turn(word(data[i : i + 8]) * c1 & mask, 31) * c2 & mask
            h1 = ((turn(h1, 27) + h2) * 5 + 0x52DCE729) & mask
            h2 ^= turn(word(data[i + 8 : i + 16]) * c2 & mask, 33) * c1 & mask
            h2 = ((turn(h2, 31) + h1) * 5 + 0x38495AB5) & mask
        rest = data[whole:]
        if len(rest) > 8:
            h2 ^= turn(word(rest[8:]) * c2 & mask, 33) * c1 & mask
        if rest:
            h1 ^= turn(word(rest[:8]) * c1 & mask, 31) * c2 & mask
        h1, h2 = h1 ^ len(data), h2 ^ len(data)
        h1 = (h1 + h2) & mask
        h2 = (h2 + h1) & mask
        out = []
        for h in (h1, h2):
            h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & mask
            h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & mask
            out.append(h ^ h >> 33)
        return (out[0] + out[1]) & mask

    r = np.random.default_rng(1)
    for k in (1, 7, 8, 16, 21, 31, 33, 51):
        text = "".join(r.choice(list("ACGT"), k + 20))
        back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want = [plain(min(text[i : i + k], back[len(text) - i - k : len(text) - i]).encode()) for i in range(21)]
        assert canonical_kmer_hashes(text, k).tolist() == want
    assert most(1000) == round(2**64 / 1000) and most(1) == 2**64 - 1
    with pytest.raises(ValueError):
        canonical_kmer_hashes("ACGT", 0)


def ladder(n):
    """A tree as deep as it has leaves."""
    root = at = tree.Node("root")
    for i in range(n):
        at.children = [tree.Node(f"l{i}", 1.0), tree.Node(None, 1.0)]
        at = at.children[1]
    at.name = f"l{n}"
    return root


def test_deep_trees_are_reshaped():
    from triloom.sources import sinks

    t = ladder(3000)
    assert tree.prune(t, {"l0", "l2999", "l3000"}).leaf_names() == ["l0", "l2999", "l3000"]
    assert len(tree.relabel(t, str.upper).leaf_names()) == 3001
    out = tree.set_outgroup(t, "l3000")
    assert out.children[0].name == "l3000" and len(out.leaf_names()) == 3001
    assert len(sinks.ascii_tree(t).splitlines()) == 6001 and sinks.svg_tree(t, [("l1", "x", "Present", "black")]).count("<rect ") == 1
    assert tree.parse_newick(tree.to_newick(tree.label_internal(ladder(40), lambda n: str(len(n))))).name == "41"


@pytest.mark.parametrize("leaf", ["a", "c", "e"])
def test_outgroup_keeps_distances(leaf):
    text = "((a:1,b:2):1.5,(c:3,d:1):0.5,e:2);"
    before = path_lengths(tree.parse_newick(text))
    t = tree.parse_newick(text)
    out = tree.set_outgroup(t, leaf)
    after = path_lengths(out)
    assert {k: pytest.approx(v) for k, v in before.items()} == after
    assert out.children[0].name == leaf and out.children[0].length == tree.parse_newick(text).leaves()[["a", "b", "c", "d", "e"].index(leaf)].length / 2
    assert tree.to_newick(t) == tree.to_newick(tree.parse_newick(text))  # the old tree is as it was
    with pytest.raises(ValueError):
        tree.set_outgroup(t, "nobody")


def test_distances_on_a_ladder(spark):
    t = ladder(30)
    want = path_lengths(t)
    nodes = tree.tree_nodes(spark, t)
    got = {(r["anchor"], r["name"]): r["distance"] for r in tree.distances(nodes, nodes.where("is_leaf and name in ('l0', 'l7', 'l30')"), chunk=4).collect()}
    assert got == {k: v for k, v in want.items() if k[0] in ("l0", "l7", "l30")}
    plan = tree.distances(nodes, nodes.where("is_leaf"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_leaves_and_paths_do_not_pass_through_the_driver(spark):
    """Stored tables are small files for what they hold: no join on them is a broadcast. Blocks have tasks of their own."""
    from triloom.operators import paths

    nodes = tree.tree_nodes(spark, ladder(30))
    leaves = nodes.where("is_leaf").select("tree_id", F.col("lft").alias("leaf"))
    above = paths.ancestors_of(paths.chains(nodes), leaves)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in above and "SortMergeJoin" in above
    plan = tree.distances(nodes, nodes.where("is_leaf"), chunk=4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("hashpartitioning(tree_id") >= 2 and "REPARTITION_BY_NUM" in plan


def test_single_linkage_is_the_minimum_bottleneck():
    r = np.random.default_rng(2)
    x = r.random((25, 25))
    m = np.minimum(x, x.T)
    np.fill_diagonal(m, 0)
    best = m.copy()
    for k in range(25):
        best = np.minimum(best, np.maximum(best[:, k : k + 1], best[k : k + 1, :]))
    d = path_lengths(tree.single_linkage([str(i) for i in range(25)], m))
    assert all(d[(str(i), str(j))] == pytest.approx(best[i, j]) for i in range(25) for j in range(25))


def test_pairs_share_hashes_in_any_blocks(spark):
    r = np.random.default_rng(5)
    rows = sorted({(int(s), int(h)) for s, h in zip(r.integers(0, 40, 600), r.integers(0, 60, 600), strict=True)} | {(s, 99) for s in range(40)})
    s = spark.createDataFrame(rows, "sample_id long, hash long")
    sets = {i: {h for x, h in rows if x == i} for i in range(40)}
    want = {(a, b): len(sets[a] & sets[b]) for a in range(40) for b in range(a + 1, 40)}
    for block, hot in ((1000, 64), (1000, 1), (7, 9)):
        assert {(x["sample_a"], x["sample_b"]): x["shared"] for x in kmer.pair_counts(s, block=block, hot=hot).collect()} == want


def test_pairs_are_counted_where_they_meet(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = sorted({(int(s), f"h{h}") for s, h in zip(r.integers(0, 60, 500), r.integers(0, 90, 500) ** 2 // 60, strict=True)} | {(s, "all") for s in range(0, 60, 2)} | {(70, "lone")})
    s = spark.createDataFrame(rows, "sample_id long, hash string")
    sets = {i: {h for x, h in rows if x == i} for i in {x for x, _ in rows}}
    want = {(a, b): 1.0 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    monkeypatch.setattr(kmer, "_AT_ONCE", 10)
    for block, hot in ((None, 16), (9, 2), (9, 0), (9, 99)):
        found = kmer.similar_pairs(s, block, hot)
        assert sorted((x["sample_a"], x["sample_b"], x["distance"]) for x in found.collect()) == sorted((*k, d) for k, d in want.items())
        # Pairs leave the unit that counts them as they are: no exchange above it.
        plan = found._jdf.queryExecution().executedPlan().toString().split("initial")[0]
        assert 0 < plan.index("MapInArrow") < plan.index("Exchange")


def test_spanning_pairs_keep_the_tree(spark):
    from triloom.operators import linkage

    r = np.random.default_rng(9)
    rows = sorted({(int(s), int(h)) for s, h in zip(r.integers(0, 80, 900), r.integers(0, 120, 900), strict=True)} | {(s, 999) for s in range(80)})
    s = spark.createDataFrame(rows, "sample_id long, hash long")
    samples = s.select("sample_id").distinct()
    tree_of = lambda pairs: sorted(tuple(x) for x in linkage.spanning_edges(pairs, samples).collect())
    want, few = tree_of(kmer.similar_pairs(s)), kmer.spanning_pairs(s, 20, 4)
    assert tree_of(few) == want and len(want) == 79
    assert few.count() < kmer.similar_pairs(s).count() / 4


def test_forest_takes_the_least_edges():
    a, b, d = np.array([1, 1, 2, 5, 3]), np.array([2, 3, 3, 6, 4]), np.array([0.5, 0.5, 0.5, 0.1, 0.9])
    assert sorted(kmer.forest(a, b, d).tolist()) == [0, 1, 3, 4]
    assert kmer.forest(a[:0], b[:0], d[:0]).tolist() == []


def test_alignments_shuffle_no_text(spark):
    from hashlib import md5

    from triloom.operators import align

    refs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "TTTTTT"), ("c", "GGGG")], "sequence string, bases string")
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "sample_id long, sample_name string")
    rows = [(0, "a", 8, 1, "T", "SNP"), (0, "a", 7, 5, "C", "INDEL"), (1, "c", 2, 1, "A", "SNP"), (1, "c", 4, 3, "T", "INDEL"), (1, "b", 1, 1, "C", "SNP"), (2, "gone", 1, 1, "A", "SNP"), (9, "a", 1, 1, "T", "SNP")]
    calls = spark.createDataFrame(rows, "sample_id long, sequence string, position int, deletion int, insertion string, var_type string")
    masks = spark.createDataFrame([(3, "b", 4, 99)], "sample_id long, sequence string, start0 long, end0 long")
    want = {"s0": "GGGGACGTACCTTTTTTT", "s1": "GAGTACGTACGTCTTTTT", "s2": "GGGGACGTACGTTTTTTT", "s3": "GGGGACGTACGTTTTTNN", "ref": "GGGGACGTACGTTTTTTT"}
    full = align.full_alignment(calls, samples, refs, masks, "ref")
    assert {r["record_id"]: r["alignment"] for r in full.collect()} == want
    told = align.full_alignment(calls, samples, refs, masks, "ref", digest=True)
    assert {r["record_id"]: r["digest"] for r in told.collect()} == {k: md5(x.encode()).hexdigest() for k, x in want.items()}
    core = align.core_alignment(calls, samples, refs, None, "ref")
    # Core positions: 2 of c, 1 and 8 of a, 1 of b; the call on an unknown sequence counts for nothing.
    assert {r["record_id"]: r["alignment"] for r in core.collect()} == {"s0": "GATT", "s1": "AATC", "s2": "GATT", "s3": "GATT", "ref": "GATT"}
    assert [tuple(r) for r in align.core_alignment(calls, None, refs, None, "ref").collect()] == [("ref", "GATT")]
    for rows in (align.full_alignment(calls, samples, refs, masks), align.core_alignment(calls, samples, refs)):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("initial")[0]
        assert 0 < plan.index("MapInArrow") < plan.index("Exchange")


def test_snp_distances_in_any_blocks(spark):
    from triloom.operators import align

    r = np.random.default_rng(6)
    rows = [(f"s{i:02}", "".join(r.choice(list("ACGTN-"), 90))) for i in range(20)] + [("none", "N" * 90)]
    a = spark.createDataFrame(rows, "record_id string, alignment string")
    want = {}
    for i, (x, p) in enumerate(rows):
        for y, q in rows[i + 1 :]:
            both = [(c, d) for c, d in zip(p, q, strict=True) if c in "ACGT" and d in "ACGT"]
            if both:
                want[tuple(sorted((x, y)))] = sum(c != d for c, d in both)
    for block, width in ((256, 1 << 15), (4, 13)):
        assert {(x["a"], x["b"]): x["distance"] for x in align.snp_distances(a, block, width).collect()} == want
    labels, length, m = align.distance_matrix(a)
    assert length == 90 and m[labels.index("s00"), labels.index("s01")] == want[("s00", "s01")]


def test_core_distances_come_from_calls_and_make_no_text(spark, monkeypatch):
    """They are those of the core alignment: with masks, alternatives of a position, unknown bases and samples without a SNP."""
    from triloom.operators import align

    r = random.Random(4)
    rows = [(s, q, p, 1, r.choice("ACGTN"), "SNP") for s in range(1, 9) for q in ("p", "q", "r") for p in r.sample(range(1, 25), 6)]
    calls = spark.createDataFrame([*rows, (1, "p", 3, 2, "A", "INDEL")], "sample_id long, sequence string, position int, deletion int, insertion string, var_type string")
    samples = spark.createDataFrame([(s, f"s{s}") for s in range(1, 11)], "sample_id long, sample_name string")
    refs = spark.createDataFrame([("p", "ACGTN" * 5), ("q", "CCGTA" * 5), ("r", "GATTA" * 5)], "sequence string, bases string")
    masks = spark.createDataFrame([("p", 0, 4), ("r", 7, 9)], "sequence string, start0 long, end0 long")
    pairs = lambda df: {(x["a"], x["b"]): x["distance"] for x in df.collect()}
    want = [pairs(align.snp_distances(align.core_alignment(calls, samples, refs, m))) for m in (None, masks)]
    monkeypatch.setattr(align, "_assembled", lambda *_: pytest.fail("texts are made"))
    for m, w in zip((None, masks), want, strict=True):
        assert len(w) == 45 and any(w.values())
        for block, width in ((1024, 1 << 14), (3, 5)):
            assert pairs(align.core_snp_distances(calls, samples, refs, m, block, width)) == w
    assert align.core_snp_distances(calls.limit(0), samples, refs).isEmpty()


def test_snp_distances_shuffle_neither_texts_nor_pairs(spark):
    """Sparse and dense columns, records of several lengths, letters beyond ASCII; no text or pair is in a shuffle."""
    from triloom.operators import align

    r = np.random.default_rng(8)
    base = r.choice(list("ACGT"), 200)
    rows = []
    for i in range(60):
        own = base.copy()
        own[r.integers(0, 200, 3)] = r.choice(list("ACGTNé-"), 3)
        own[150:170] = r.choice(list("ACGTN"), 20)
        rows.append((f"s{i:02}", "".join(own)[: 200 - 40 * (i % 7 == 0)]))
    rows += [("empty", ""), ("null", None)]
    want = {}
    for i, (x, p) in enumerate(rows):
        for y, q in rows[i + 1 :]:
            both = [(c, d) for c, d in zip(p or "", q or "", strict=False) if c in "ACGT" and d in "ACGT"]
            if both:
                want[tuple(sorted((x, y)))] = sum(c != d for c, d in both)
    a = spark.createDataFrame(rows, "record_id string, alignment string")
    for block, width in ((1024, 1 << 15), (9, 64)):
        found = align.snp_distances(a, block, width)
        assert {(x["a"], x["b"]): x["distance"] for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(i#" in line for line in exchanges) and "bases" not in plan


def test_within_asks_few_where_all_share_a_hash(spark):
    """Random sets and one hash that all have, against all pairs; candidates are far fewer than pairs."""
    import random

    r = random.Random(8)
    base = [{0} | {r.randrange(1, 4000) for _ in range(30)} for _ in range(40)]
    sets = {i: base[i % 40] if i < 40 else {x if r.random() < 0.9 else r.randrange(1, 4000) for x in base[i % 40]} | {0} for i in range(200)}
    s = spark.createDataFrame([(i, h) for i, hs in sets.items() for h in hs], "sample_id long, hash long")
    a = spark.createDataFrame([(i,) for i in range(0, 200, 7)], "sample_id long")
    for distance in (0.0, 0.2, 0.5, 0.9):
        want = {j for i in range(0, 200, 7) for j in sets if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 1 - distance}
        assert {x[0] for x in kmer.within(s, a, distance).collect()} == want
    assert kmer.near_candidates(s, a, 0.3).count() < 29 * 200 / 10
    assert kmer.within(s, a, 1.0).count() == 200


def test_bottom_sketches_and_abundances(spark):
    from triloom.functions.hashing import canonical_kmer_hashes

    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("ACGT"), 300)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1] + texts[2]), (3, texts[3]), (4, "AC"), (4, None), (5, "ACGTACGTTTGA" * 20)]
    df = spark.createDataFrame(rows, "sample_id long, bases string")
    counts = {}
    for i, bases in rows:
        for h in canonical_kmer_hashes(bases or "", 11).tolist():
            counts.setdefault(i, {}).setdefault(h, 0)
            counts[i][h] += 1
    for num in (5, 60, 10_000):
        got = {}
        for x in kmer.dna_sketch(df, 11, None, num=num, abund=True).collect():
            got.setdefault(x["sample_id"], {})[x["hash"] % 2**64] = x["abundance"]
        want = {i: dict(sorted(c.items())[:num]) for i, c in counts.items()}
        assert got == want
        near = {(x["sample_a"], x["sample_b"]): x["distance"] for x in kmer.num_distances(kmer.dna_sketch(df, 11, None, num=num), num).collect()}
        for a in want:
            for b in want:
                if a < b:
                    both = sorted({*want[a], *want[b]})[:num]
                    shared = sum(h in want[a] and h in want[b] for h in both)
                    expect = 1 - shared / len(both)
                    assert near.get((a, b), 1.0) == pytest.approx(expect)
    with pytest.raises(ValueError):
        kmer.dna_sketch(df, 11, 1000, num=5)
