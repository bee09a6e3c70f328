import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triloom.operators import cluster, kmer, linkage, order, paths, tree


def grown(n, seed):
    """A random tree with leaves x0, x1, ..., and nodes of one to three children."""
    r = random.Random(seed)
    nodes = [tree.Node(f"x{i}", r.randrange(5)) for i in range(n)]
    while len(nodes) > 1:
        pick = [nodes.pop(r.randrange(len(nodes))) for _ in range(min(len(nodes), r.choice([1, 2, 2, 2, 3])))]
        nodes.append(tree.Node(None, r.randrange(5), pick))
    return nodes[0]


def ladder(n):
    out = tree.Node("x0", 1.0)
    for i in range(1, n):
        out = tree.Node(None, 1.0, [out, tree.Node(f"x{i}", 2.0)])
    return out


ROOTS = {"one": grown(1, 0), "two": grown(2, 1), "some": grown(7, 2), "many": grown(40, 3), "ladder": ladder(30)}


@pytest.fixture(scope="module")
def forest(spark):
    out = None
    for name, root in ROOTS.items():
        table = tree.tree_nodes(spark, root, name)
        out = table if out is None else out.union(table)
    return out.cache()


def names(spark, listed):
    return spark.createDataFrame([(n,) for n in listed], "name string")


def test_common_ancestors_of_all_pairs(forest):
    leaf = forest.where("is_leaf").select("tree_id", F.col("lft").alias("lo"))
    pairs = leaf.join(leaf.withColumnRenamed("lo", "hi"), "tree_id")
    nodes = forest.collect()
    got = paths.common_ancestors(paths.chains(forest), pairs).collect()
    assert len(got) == pairs.count()
    for x in got:
        lo, hi = sorted((x.lo, x.hi))
        best = max((n for n in nodes if n.tree_id == x.tree_id and n.lft <= lo and n.rgt >= hi), key=lambda n: n.depth)
        assert (x.node_id, x.lft, x.rgt, x.depth) == (best.node_id, best.lft, best.rgt, best.depth)


def test_entries_are_n_log_n_on_a_ladder(spark):
    nodes = tree.tree_nodes(spark, ladder(1500))
    at = paths.chains(nodes)
    leaves = nodes.where("is_leaf").select("tree_id", F.col("lft").alias("leaf"))
    assert paths.entries(at, leaves).count() <= 1500 * 11


def test_ancestors(forest):
    chosen = forest.where("is_leaf and name in ('x1', 'x6')").select("tree_id", F.col("lft").alias("leaf"))
    got = {(x.tree_id, x.leaf, x.node_id) for x in paths.ancestors_of(paths.chains(forest), chosen).collect()}
    want = {(n.tree_id, c.leaf, n.node_id) for c in chosen.collect() for n in forest.collect() if n.tree_id == c.tree_id and n.lft <= c.leaf <= n.rgt}
    assert got == want


def test_least_distances_against_all_pairs(spark, forest):
    anchors = names(spark, ["x1", "x5", "gone"])
    want = {}
    for name in ROOTS:
        for x in tree.distances(forest.where(F.col("tree_id") == name), anchors).collect():
            want[name, x.name] = min(want.get((name, x.name), 1e9), x.distance)
    assert {(x.tree_id, x.name): x.distance for x in paths.least_distances(forest, anchors).collect()} == pytest.approx(want)


@pytest.mark.parametrize("kept", [["x1", "x5", "x6", "x20", "x21"], ["x0"], ["x3", "x4"], [f"x{i}" for i in range(40)], ["gone"]])
def test_pruned_like_the_driver(spark, forest, kept):
    got = {}
    for x in paths.pruned(forest, names(spark, kept)).collect():
        got.setdefault(x.tree_id, []).append(x)
    for name, root in ROOTS.items():
        one = tree.prune(root, set(kept))
        if one is None:
            assert name not in got
            continue
        row = lambda lo, hi, depth, n, length, dist, leaf: (lo, hi, depth, n or "", round(length, 6), round(dist, 6), leaf)
        want = sorted(row(a[7], a[8], a[5], a[3], a[4], a[6], a[9]) for a in tree.node_rows(one, name))
        assert sorted(row(x.lft, x.rgt, x.depth, x.name, x.branch_length, x.root_dist, x.is_leaf) for x in got[name]) == want
        by_id = {x.node_id: x for x in got[name]}
        for x in got[name]:
            up = by_id.get(x.parent_id)
            assert (up is None) == (x.depth == 0) and (up is None or up.depth == x.depth - 1 and up.lft <= x.lft <= x.rgt <= up.rgt)


def test_pruned_table_makes_the_same_newick(spark, forest):
    table = paths.pruned(forest.where("tree_id = 'many'"), names(spark, ["x3", "x9", "x17", "x30"]))
    assert tree.to_newick(tree.from_nodes(table)) == tree.to_newick(tree.prune(ROOTS["many"], {"x3", "x9", "x17", "x30"}))


def test_cluster_scores_of_two_trees_are_those_of_each(spark):
    one, two = tree.parse_newick("((a:1,b:1):1,(c:1,d:1):1);"), tree.parse_newick("((a:1,c:1):1,(b:1,d:1):1);")
    groups = spark.createDataFrame([("ab", "a"), ("ab", "b"), ("ac", "a"), ("ac", "c"), ("none", "z")], "group string, name string")
    both = tree.tree_nodes(spark, one, "one").union(tree.tree_nodes(spark, two, "two"))
    got = {(r["group"], r["tree_id"]): r["score"] for r in cluster.mrca_jaccard(both, groups).collect()}
    for name, root in (("one", one), ("two", two)):
        for r in cluster.mrca_jaccard(tree.tree_nodes(spark, root, name), groups).where("tree_id is not null").collect():
            assert got[r["group"], name] == r["score"]
    assert got["ab", "one"] == 1 and got["ab", "two"] == 0.5 and got["none", None] != got["none", None]


def test_values_below_nodes(forest):
    leaves = forest.where("is_leaf").select("tree_id", F.col("lft").alias("leaf"), (F.col("lft") % 3).alias("value"))
    got = {(x.tree_id, x.node_id, x.value): x.n for x in paths.below(forest, leaves).collect()}
    want = {}
    for n in forest.collect():
        for i in range(n.lft, n.rgt + 1):
            want[n.tree_id, n.node_id, i % 3] = want.get((n.tree_id, n.node_id, i % 3), 0) + 1
    assert got == want


def test_running_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 7)
    r = random.Random(2)
    rows = [(p, i, r.randrange(-9, 9)) for p in ("a", "b") for i in r.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "p string, i int, v long")
    for how, plain in ((F.sum, sum), (F.min, min), (F.max, max)):
        for inclusive in (True, False):
            for backwards in (True, False):
                for x in order.running(df, ["p"], "i", "v", "out", how, inclusive, backwards).collect():
                    seen = [v for p, i, v in rows if p == x.p and (i == x.i and inclusive or (i > x.i if backwards else i < x.i))]
                    assert x.out == (plain(seen) if seen else None)


def test_ranges_are_made_of_aligned_blocks(spark):
    spans = [(a, b) for a in range(1, 20) for b in range(a, 40)] + [(1, 2**30), (5, 2**31)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", order.covers(F.col("a"), F.col("b")).alias("c"))
    for x in df.collect():
        parts = sorted((c.block << c.level, (c.block + 1) << c.level) for c in x.c)
        assert parts[0][0] == x.a and parts[-1][1] == x.b + 1 and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (x.b - x.a + 1).bit_length()


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_edges_against_prim(spark, seed):
    r = random.Random(seed)
    n = 40
    m = np.ones((n, n))
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            if r.random() < 0.06:
                m[i, j] = m[j, i] = r.randrange(1, 9) / 10
                pairs.append((i, j, float(m[i, j])))
    np.fill_diagonal(m, 0)
    samples = spark.createDataFrame([(i,) for i in range(n)], "sample_id long")
    edges = linkage.spanning_edges(spark.createDataFrame(pairs, "sample_a long, sample_b long, distance double"), samples)
    rows = [(e["distance"], e["sample_a"], e["sample_b"]) for e in edges.collect()]
    assert len(rows) == n - 1
    labels = [str(i) for i in range(n)]
    one, two = tree.dendrogram(labels, rows), tree.single_linkage(labels, m)
    assert sorted((x.name, round(x.length, 9)) for x in one.leaves()) == sorted((x.name, round(x.length, 9)) for x in two.leaves())
    clades = lambda t: sorted(round(x.length, 9) for x in _inner(t))
    assert clades(one) == clades(two)
    heights = {h["sample_id"]: h["height"] for h in linkage.leaf_heights(edges, samples).collect()}
    assert heights == pytest.approx({int(x.name): x.length for x in two.leaves()})


def _inner(root):
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out += [x] if x.children else []
        todo += x.children
    return out


def test_linkage_of_one_and_of_lone_samples(spark):
    empty = spark.createDataFrame([], "sample_a long, sample_b long, distance double")
    one = spark.createDataFrame([(7,)], "sample_id long")
    assert linkage.spanning_edges(empty, one).count() == 0
    assert [tuple(r) for r in linkage.leaf_heights(linkage.spanning_edges(empty, one), one).collect()] == [(7, 0.0)]
    three = spark.createDataFrame([(7,), (8,), (9,)], "sample_id long")
    assert sorted(tuple(r) for r in linkage.spanning_edges(empty, three).collect()) == [(7, 8, 1.0), (7, 9, 1.0)]


def test_newick_comments_outside_of_quotes_only():
    root = tree.parse_newick("('a[1]':1[&c=2],[x]b:2,('c''d':1)[y]e:3)[z];")
    assert root.leaf_names() == ["a[1]", "b", "c'd"] and root.children[2].name == "e"
    assert tree.parse_newick(tree.to_newick(root)).leaf_names() == root.leaf_names()


def test_kmer_tree_without_a_matrix(spark):
    sets = {1: range(10), 2: range(5, 15), 3: range(100, 110), 4: range(10)}
    sketch = spark.createDataFrame([(i, 31, h) for i, hs in sets.items() for h in hs], "sample_id long, ksize int, hash long")
    samples = sketch.select("sample_id").distinct()
    edges = {(e["sample_a"], e["sample_b"]): e["distance"] for e in linkage.spanning_edges(kmer.similar_pairs(sketch), samples).collect()}
    assert edges == pytest.approx({(1, 4): 0.0, (1, 2): 2 / 3, (1, 3): 1.0})
