"""Trees, clusters and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators import cluster, linkage, paths, tree
from triloom.plans.projection import Tables
from triloom.plans.q_states import H1, H12, h, q
from triloom.plans.registry import query
from triloom.query import SamplesQuery
from triloom.session import written

_ANCHORS = "SELECT c_name AS name FROM customer WHERE c_custkey % 100 = 0"


def _anchors(t: Tables) -> DataFrame:
    return t.samples.where("sample_id % 100 = 0").select(F.col("sample_name").alias("name"))


_MRCA = {
    "an": _ANCHORS,
    "sp": "SELECT min(lft) AS lo, max(lft) AS hi FROM tree WHERE is_leaf AND name IN (SELECT name FROM an)",
    "mr": "SELECT lft, rgt, root_dist FROM tree, sp WHERE lft <= lo AND rgt >= hi ORDER BY depth DESC LIMIT 1",
}


@query("tree_mrca", "SELECT 'tree' AS tree_id, * FROM mr", **_MRCA)
def _(t: Tables) -> DataFrame:
    return tree.mrca(t.tree, _anchors(t))


@query("within_mrca", "SELECT sample_id, CASE WHEN lft BETWEEN (SELECT lft FROM mr) AND (SELECT rgt FROM mr) THEN 2 ELSE 0 END AS status FROM samples JOIN tree ON name = sample_name AND is_leaf", **_MRCA)
def _(t: Tables) -> DataFrame:
    return q(t).join_nodes(t.tree).isin(t.samples.where("sample_id % 100 = 0"), kind="mrca").state


_LCA = {
    "an": _ANCHORS,
    "ld": """SELECT a.name AS anchor, b.name, a.root_dist + b.root_dist - 2 * max(n.root_dist) AS distance FROM tree a JOIN an ON an.name = a.name JOIN tree b ON b.is_leaf JOIN tree n ON n.lft <= least(a.lft, b.lft) AND n.rgt >= greatest(a.lft, b.lft) WHERE a.is_leaf GROUP BY a.name, b.name, a.root_dist, b.root_dist""",
}


@query("lca_join", "SELECT * FROM ld", **_LCA)
def _(t: Tables) -> DataFrame:
    return tree.distances(t.tree, _anchors(t))


_NEAR = "SELECT sample_id, CASE WHEN sample_name IN (SELECT name FROM ld WHERE distance <= 14) THEN 2 ELSE 0 END AS status FROM samples"


@query("within_tree_distance", _NEAR, **_LCA)
def _(t: Tables) -> DataFrame:
    return q(t).join_nodes(t.tree).isin(t.samples.where("sample_id % 100 = 0"), kind="distance", distance=14, units="substitutions/site").state


@query("within", _NEAR, **_LCA)
def _(t: Tables) -> DataFrame:
    return q(t).join_nodes(t.tree).within(t.samples.where("sample_id % 100 = 0"), distance=14).state


@query("join_tree", "SELECT sample_id, CASE WHEN sample_name IN (SELECT name FROM leaf WHERE r_name = 'ASIA') THEN status ELSE 0 END AS status FROM h1 JOIN samples USING (sample_id)", **H1)
def _(t: Tables) -> DataFrame:
    """The tree of one region: leaves outside it become absent."""
    asia = t.tree.where("name = 'ASIA' and not is_leaf").select("tree_id", "lft", "rgt")
    nodes = t.tree.join(F.broadcast(asia.select(F.col("lft").alias("_lo"), F.col("rgt").alias("_hi"))), F.col("lft").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one row
    return h(t, 1).join_nodes(nodes).state


@query("tree_from_reference", "SELECT n_name AS name, CAST(r_regionkey + 2 + n_nationkey % 7 AS DOUBLE) AS root_dist, 2 AS status FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    """The query on a reference that has a tree: its leaves are the samples that are selected."""
    from triloom.plans.q_files import _on_tree

    on = _on_tree(t)
    selected = on.state.join(on.db.samples, "sample_id").select(F.col("sample_name").alias("name"), "status")
    return on.nodes.where("is_leaf").select("name", "root_dist").join(selected, "name")


@query("tree_label_internal", "SELECT n.name, count(*) AS leaves, count(DISTINCT segment) AS segments FROM tree n JOIN tree l ON l.is_leaf AND l.lft BETWEEN n.lft AND n.rgt JOIN metadata m ON m.name = l.name WHERE NOT n.is_leaf GROUP BY 1")
def _(t: Tables) -> DataFrame:
    leaves = t.tree.where("is_leaf").join(t.metadata, "name").select("tree_id", F.col("lft").alias("leaf"), F.col("segment").alias("value"))
    inner = t.tree.where("not is_leaf").select("tree_id", "node_id", "name")
    counted = paths.below(t.tree, leaves).groupBy("tree_id", "node_id").agg(F.sum("n").alias("leaves"), F.count("*").alias("segments"))
    return inner.join(counted, ["tree_id", "node_id"]).select("name", "leaves", "segments")


def _score(groups: str) -> str:
    return f"""SELECT CAST(g.grp AS VARCHAR) AS "group", count(*) AS samples, CAST(count(*) AS DOUBLE) / (SELECT n.rgt - n.lft + 1 FROM tree n WHERE n.lft <= min(l.lft) AND n.rgt >= max(l.lft) ORDER BY depth DESC LIMIT 1) AS score FROM ({groups}) g JOIN tree l ON l.name = g.name AND l.is_leaf GROUP BY 1"""


def _groups(t: Tables) -> DataFrame:
    return t.metadata.select("name", F.col("nation").cast("string").alias("group"))


@query("cluster_score", f'SELECT "group", score FROM ({_score("SELECT name, nation AS grp FROM metadata")})')
def _(t: Tables) -> DataFrame:
    return cluster.mrca_jaccard(t.tree, _groups(t)).drop("tree_id")


@query("cluster_score_entry", f'SELECT "group", samples, score FROM ({_score("SELECT name, segment AS grp FROM metadata")})')
def _(t: Tables) -> DataFrame:
    return q(t).join_nodes(t.tree).join(t.metadata.drop("name"), sample_ids_column="sample_id").score_groups("segment").drop("tree_id")


@query("cluster_score_groupby", f'SELECT * FROM ({_score("SELECT name, nation AS grp FROM metadata")}) WHERE samples >= 2')
def _(t: Tables) -> DataFrame:
    return cluster.score_groupby(t.tree, t.metadata, "nation", min_samples=2).drop("tree_id")


_P = {
    "cp": "SELECT spdi AS feature, segment AS category, CAST(count(*) AS DOUBLE) AS p FROM calls JOIN metadata USING (sample_id) WHERE insertion <> '?' GROUP BY 1, 2",
    "np": "SELECT feature, category, p / sum(p) OVER (PARTITION BY category) AS p FROM cp",
    "full_": "SELECT a.category AS a, b.category AS b, f.feature, coalesce(x.p, 0) AS pa, coalesce(y.p, 0) AS pb FROM (SELECT DISTINCT category FROM np) a JOIN (SELECT DISTINCT category FROM np) b ON a.category < b.category JOIN (SELECT DISTINCT feature FROM np) f ON true LEFT JOIN np x ON x.feature = f.feature AND x.category = a.category LEFT JOIN np y ON y.feature = f.feature AND y.category = b.category",
}


@query("categories_cluster_js", "SELECT a, b, round(sqrt(sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) / 2 ELSE 0 END + CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) / 2 ELSE 0 END)), 9) AS distance FROM full_ GROUP BY 1, 2", **_P)
def _(t: Tables) -> DataFrame:
    c = t.features.where("insertion <> '?'").join(t.metadata, "sample_id").groupBy("feature", F.col("segment").alias("category")).agg(F.count("*").cast("double").alias("p"))
    return cluster.jensen_shannon(c).withColumn("distance", F.round("distance", 9))


_COLORS = "CASE status WHEN 2 THEN 'black' WHEN 1 THEN 'lightgray' ELSE 'white' END"
_LABEL = "CASE status WHEN 2 THEN 'Present' WHEN 1 THEN 'Unknown' ELSE 'Absent' END"
_STYLE = f"SELECT sample_name AS leaf, 'first' AS \"column\", {_LABEL} AS status, {_COLORS} AS color FROM h1 JOIN samples USING (sample_id) UNION ALL SELECT sample_name, 'second', {_LABEL}, {_COLORS} FROM h2 JOIN samples USING (sample_id)"

for _name in ("tree_style", "annotate_tree_column"):

    @query(_name, _STYLE, **H12)
    def _(t: Tables) -> DataFrame:
        return q(t).join_nodes(t.tree).tree_annotations({"first": h(t, 1), "second": h(t, 2)})


# The tree operators below run on the driver; a query shows their result as a table.


def _newick(t: Tables) -> tree.Node:
    """Regions and nations as a tree: as many leaves as nations."""
    rows = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_regionkey", "n_nationkey").collect()
    root = tree.Node("root")
    by: dict[str, tree.Node] = {}
    for r in rows:
        if r["r_name"] not in by:
            by[r["r_name"]] = tree.Node(r["r_name"], r["r_regionkey"] + 1.0)
            root.children.append(by[r["r_name"]])
        by[r["r_name"]].children.append(tree.Node(r["n_name"], r["n_nationkey"] % 7 + 1.0))
    return tree.parse_newick(tree.to_newick(root))


@query("scan_newick", "SELECT n_name AS name, CAST(r_regionkey + 2 + n_nationkey % 7 AS DOUBLE) AS root_dist FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    return tree.tree_nodes(t.spark, _newick(t)).where("is_leaf").select("name", "root_dist")


def _kept(which: str) -> str:
    """Leaves of the pruned tree: an inner node is left where two of its children are."""
    return f"""SELECT name, root_dist - min(base) OVER () AS root_dist, depth, lft FROM (SELECT name, root_dist, 0.0 AS base, CAST(1 + CASE WHEN nations > 1 THEN 1 ELSE 0 END + CASE WHEN leaves > 1 THEN 1 ELSE 0 END AS INTEGER) AS depth,
CAST(row_number() OVER (ORDER BY lft) AS INTEGER) AS lft FROM (SELECT *, count(*) OVER (PARTITION BY r_name, n_name) AS leaves, list_unique(list(n_name) OVER (PARTITION BY r_name)) AS nations FROM leaf WHERE {which}))"""


@query("tree_prune", _kept("r_name <> 'ASIA' AND CAST(substr(name, 10) AS BIGINT) % 29 = 0"))
def _(t: Tables) -> DataFrame:
    """Every 29th customer outside of Asia: many nations are left with one leaf and are merged with it."""
    place = t.raw("nation").join(t.raw("region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    keep = t.metadata.where("sample_id % 29 = 0").join(place, F.col("nation") == F.col("n_nationkey"), "left_semi")
    return paths.pruned(t.tree, keep).where("is_leaf").select("name", "root_dist", "depth", "lft")


_NATIONS = "SELECT n_name AS name, n_nationkey % 7 + 1 AS own, r_regionkey + 1 AS up, r_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("tree_set_outgroup", "SELECT a.name AS anchor, b.name, CAST(CASE WHEN a.name = b.name THEN 0 WHEN a.r = b.r THEN a.own + b.own ELSE a.own + a.up + b.own + b.up END AS DOUBLE) AS distance FROM nn a, nn b", nn=_NATIONS)
def _(t: Tables) -> DataFrame:
    """Re-rooted, all distances between leaves stay."""
    root = _newick(t)
    nodes = tree.tree_nodes(t.spark, tree.set_outgroup(root, min(root.leaf_names())))
    return tree.distances(nodes, nodes.where("is_leaf")).withColumn("distance", F.round("distance", 6))


@query("tree_relabel", "SELECT lower(n_name) AS name FROM nation")
def _(t: Tables) -> DataFrame:
    return tree.tree_nodes(t.spark, tree.relabel(_newick(t), str.lower)).where("is_leaf").select("name")


_KPAIRS = "SELECT a.sample_id AS x, b.sample_id AS y, count(*) AS shared FROM sketch a JOIN sketch b ON a.hash = b.hash AND a.sample_id <> b.sample_id WHERE a.sample_id IN (SELECT sample_id FROM samples) AND b.sample_id IN (SELECT sample_id FROM samples) GROUP BY 1, 2"


@query(
    "build_tree_kmer",
    "SELECT sample_name AS name, coalesce(min(1.0 - CAST(shared AS DOUBLE) / CAST(a.n + b.n - shared AS DOUBLE)), 1.0) / 2 AS branch_length FROM sz a JOIN samples USING (sample_id) LEFT JOIN kp ON kp.x = a.sample_id LEFT JOIN sz b ON b.sample_id = kp.y GROUP BY 1",
    sz="SELECT sample_id, count(*) AS n FROM sketch GROUP BY 1",
    kp=_KPAIRS,
)
def _(t: Tables) -> DataFrame:
    """Single linkage of the documents: a leaf's branch is half its distance to the nearest other one."""
    t.sketch = written(t.sketch, "sketch")
    own = q(t).intersect(t.with_kmer_index())
    chosen = own.state.where("status = 2")
    return linkage.leaf_heights(own.linkage(kmer_size=3), chosen).join(t.samples, "sample_id").select(F.col("sample_name").alias("name"), F.col("height").alias("branch_length"))


_SNPS = "SELECT DISTINCT sample_name AS s, spdi FROM calls JOIN refs USING (sequence) JOIN samples USING (sample_id) WHERE var_type = 'SNP' AND reference_name = 'genome'"


@query(
    "build_tree_mutation",
    "SELECT a.s AS a, b.s AS b, CAST(a.n + b.n - 2 * coalesce(both_, 0) AS DOUBLE) AS distance FROM cn a JOIN cn b ON a.s < b.s LEFT JOIN sh ON sh.a = a.s AND sh.b = b.s",
    sn=_SNPS,
    cn="SELECT sample_name AS s, count(spdi) AS n FROM (SELECT DISTINCT sample_name FROM calls JOIN refs USING (sequence) JOIN samples USING (sample_id) WHERE reference_name = 'genome') LEFT JOIN sn ON s = sample_name GROUP BY 1",
    sh="SELECT x.s AS a, y.s AS b, count(*) AS both_ FROM sn x JOIN sn y ON x.spdi = y.spdi AND x.s < y.s GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    """What the tree of the samples on a reference is joined by: the SNP distances of their alignment."""
    t.calls = written(t.calls, "calls")
    return SamplesQuery.on_reference(t, "genome").snp_distance_pairs("genome")


@query("experimental_tree_query", _kept("r_name <> 'ASIA'"))
def _(t: Tables) -> DataFrame:
    """The tree follows the selection, and the universe's tree stays: what is absent comes back by complement."""
    asia = t.raw("nation").join(t.raw("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    there = t.metadata.join(asia, F.col("nation") == F.col("n_nationkey"), "left_semi")
    return q(t).join_nodes(t.tree).experimental().isin(there).complement().nodes.where("is_leaf").select("name", "root_dist", "depth", "lft")
