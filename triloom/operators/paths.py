"""Ancestors, common ancestors, nearest leaves and pruned trees on nested-set tables, in about n log n rows.

The class of a node is the base-2 logarithm of its leaves, rounded down. A node has one child of its own
class at most, so nodes of a class form paths, and from a leaf to the root there are as many paths as
classes at most, however deep the tree is. A leaf hangs on each of its paths at one node, its entry: those
are found by equal joins on aligned blocks of leaf numbers. Two leaves' last common ancestor is the higher
one of their entries to the lowest path that they share.

Tables hold tree_id, node_id, parent_id, lft, rgt, root_dist and depth; several trees may share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.operators.order import covers, in_blocks, running
from triloom.session import written

_NODE = ["node_id", "lft", "rgt", "root_dist", "depth"]


def _class(lft: str = "lft", rgt: str = "rgt") -> Column:
    return F.length(F.bin(F.col(rgt).cast("long") - F.col(lft) + 1)) - 1


def chains(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, lft, rgt, root_dist, depth, class, head, below_lft, below_rgt): each node with
    its path, named by class and the first leaf of its top node, and the range of the next node on it.
    The table is written, as what is asked of it reads it several times."""
    n = nodes.select("tree_id", "parent_id", *_NODE).withColumn("class", _class())
    above = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("class").alias("_class"))
    n = n.join(above.hint("merge"), ["tree_id", "parent_id"], "left")  # all nodes: no broadcast through the driver
    heads = n.where(F.col("_class").isNull() | (F.col("_class") != F.col("class")))
    below = n.where(F.col("_class") == F.col("class")).select("tree_id", F.col("parent_id").alias("node_id"), F.col("lft").alias("below_lft"), F.col("rgt").alias("below_rgt"))
    # A head of class c spans three buckets of 2^c leaf numbers at most; heads of a class are apart.
    bucket = lambda x: F.call_function("shiftright", F.col(x).cast("long"), F.col("class"))
    heads = heads.select("tree_id", "class", F.col("lft").alias("head"), F.col("rgt").alias("_end"), F.explode(F.sequence(bucket("lft"), bucket("rgt"))).alias("_bucket"))
    own = n.select("tree_id", *_NODE, "class", bucket("lft").alias("_bucket")).join(heads.hint("merge"), ["tree_id", "class", "_bucket"]).where("lft between head and _end")
    return written(own.drop("_bucket", "_end").join(below.hint("merge"), ["tree_id", "node_id"], "left"), "paths")


def entries(paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree_id, leaf, class, head, node_id, lft, rgt, root_dist, depth): where each leaf number (leaf) hangs
    on each of its paths."""
    apart = F.when(F.col("below_lft").isNull(), covers(F.col("lft"), F.col("rgt"))).otherwise(
        F.concat(
            F.when(F.col("lft") < F.col("below_lft"), covers(F.col("lft"), F.col("below_lft") - 1)).otherwise(F.filter(covers(F.col("lft"), F.col("lft")), lambda _: F.lit(False))),
            F.when(F.col("below_rgt") < F.col("rgt"), covers(F.col("below_rgt") + 1, F.col("rgt"))).otherwise(F.filter(covers(F.col("lft"), F.col("lft")), lambda _: F.lit(False))),
        )
    )
    held = paths.select("tree_id", "class", "head", *_NODE, F.explode(apart).alias("b")).select("tree_id", "class", "head", *_NODE, "b.level", "b.block")
    levels = paths.agg(F.coalesce(F.max("class"), F.lit(0))).scalar()
    asked = in_blocks(leaves.select("tree_id", "leaf").distinct(), "leaf", levels)
    # Files of such tables are small for what they hold, and a broadcast passes through the driver.
    return asked.join(held.hint("merge"), ["tree_id", "level", "block"]).drop("level", "block")


def common_ancestors(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, lo, hi, node_id, lft, rgt, root_dist, depth): the last common ancestor of each pair of leaf
    numbers (tree_id, lo, hi). A pair of one leaf has that leaf."""
    pairs = pairs.select("tree_id", "lo", "hi").distinct()
    at = entries(paths, pairs.select("tree_id", F.col("lo").alias("leaf")).union(pairs.select("tree_id", F.col("hi").alias("leaf"))))
    one = at.select("tree_id", F.col("leaf").alias("lo"), "class", "head", F.struct("depth", *[c for c in _NODE if c != "depth"]).alias("one"))
    two = at.select("tree_id", F.col("leaf").alias("hi"), "class", "head", F.struct("depth", *[c for c in _NODE if c != "depth"]).alias("two"))
    met = pairs.join(one, ["tree_id", "lo"]).join(two, ["tree_id", "hi", "class", "head"])
    higher = F.when(F.col("one.depth") <= F.col("two.depth"), F.col("one")).otherwise(F.col("two"))
    best = met.groupBy("tree_id", "lo", "hi").agg(F.min_by(higher, "class").alias("n"))
    return best.select("tree_id", "lo", "hi", *[f"n.{c}" for c in _NODE])


def ancestors_of(paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree_id, leaf, node_id, lft, rgt, root_dist, depth): all nodes above the asked leaf numbers, and they."""
    hung = entries(paths, leaves).select("tree_id", "leaf", "class", "head", F.col("depth").alias("_depth"))
    return hung.join(paths.select("tree_id", "class", "head", *_NODE).hint("merge"), ["tree_id", "class", "head"]).where("depth <= _depth").select("tree_id", "leaf", *_NODE)


def least_distances(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(tree_id, name, distance) of every leaf to the nearest leaf with one of the anchors' names.

    On the lowest path that two leaves share, they are as far apart as each is from its entry, and the entries
    from each other; on higher ones that sum is no less. So nearest anchors run along each path both ways.
    Branch lengths must not be negative. Trees without an anchor have no rows.
    """
    paths = chains(nodes)
    leaf = nodes.where("is_leaf").select("tree_id", "name", F.col("lft").alias("leaf"), F.col("root_dist").alias("own"))
    chosen = leaf.join(anchors.select("name").distinct(), "name", "left_semi").select("tree_id", "leaf", "own")
    hung = entries(paths, chosen).join(chosen, ["tree_id", "leaf"]).groupBy("tree_id", "node_id").agg(F.min("own").alias("own"))
    there = hung.join(paths.select("tree_id", "node_id", "class", "head", "root_dist", "depth"), ["tree_id", "node_id"])
    part = ["tree_id", "class", "head"]
    line = written(paths.select(*part, "node_id", "root_dist", "depth").join(there.select(*part).distinct(), part, "left_semi").join(hung, ["tree_id", "node_id"], "left").withColumn("_up", F.col("own") - 2 * F.col("root_dist")), "line")
    line = running(line, part, "depth", "_up", "above", F.min)
    line = running(line, part, "depth", "own", "below", F.min, backwards=True)
    best = line.select("tree_id", "node_id", F.least(F.col("above") + F.col("root_dist"), F.col("below") - F.col("root_dist")).alias("best"))
    mine = entries(paths, leaf).select("tree_id", "leaf", "node_id", "root_dist").join(best, ["tree_id", "node_id"])
    near = mine.join(leaf, ["tree_id", "leaf"]).groupBy("tree_id", "leaf", "name").agg(F.min(F.col("own") - F.col("root_dist") + F.col("best")).alias("distance"))
    return near.select("tree_id", "name", "distance")


def below(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(tree_id, node_id, value, n): how often each value (tree_id, leaf, value) stands below each node.

    Values are counted in aligned blocks of leaf numbers, and a node adds up the few blocks of its range.
    """
    levels = nodes.agg(F.coalesce(F.max(_class()), F.lit(0))).scalar()
    held = in_blocks(values.select("tree_id", "leaf", "value"), "leaf", levels).groupBy("tree_id", "level", "block", "value").agg(F.count("*").alias("n"))
    spans = nodes.select("tree_id", "node_id", F.explode(covers(F.col("lft"), F.col("rgt"))).alias("b")).select("tree_id", "node_id", "b.level", "b.block")
    return spans.join(held, ["tree_id", "level", "block"]).groupBy("tree_id", "node_id", "value").agg(F.sum("n").alias("n"))


def pruned(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The tables of the trees of the leaves with these names: nodes with one child are merged and lengths
    summed, leaves numbered anew, and the last common ancestor of what is left is the root, of length 0.

    Inner nodes are the last common ancestors of neighbouring leaves; a node's parent is the lower one of
    those just outside its range. A tree without such a leaf has no rows.
    """
    kept = nodes.where("is_leaf").join(names.select("name").distinct(), "name", "left_semi").select("tree_id", *_NODE, F.lit(1).alias("one"))
    kept = written(running(written(kept, "kept"), ["tree_id"], "lft", "one", "rank"), "ranked")
    after = kept.select("tree_id", (F.col("rank") - 1).alias("rank"), F.col("lft").alias("hi"))
    pairs = kept.select("tree_id", "rank", F.col("lft").alias("lo")).join(after, ["tree_id", "rank"])
    bounds = written(pairs.join(common_ancestors(chains(nodes), pairs), ["tree_id", "lo", "hi"]).select("tree_id", "rank", *_NODE), "bounds")
    inner = bounds.select("tree_id", *_NODE).distinct()
    # Kept leaves before and up to the ends of each inner node's range.
    ends = inner.select("tree_id", F.explode(F.array("lft", "rgt")).alias("at"), F.lit(0).alias("one")).union(kept.select("tree_id", F.col("lft").alias("at"), "one"))
    ends = ends.groupBy("tree_id", "at").agg(F.sum("one").alias("one"))
    ends = running(ends, ["tree_id"], "at", "one", "upto")
    first = ends.select("tree_id", F.col("at").alias("lft"), (F.col("upto") - F.col("one") + 1).alias("lo"))
    last = ends.select("tree_id", F.col("at").alias("rgt"), F.col("upto").alias("hi"))
    inner = written(inner.join(first, ["tree_id", "lft"]).join(last, ["tree_id", "rgt"]).select("tree_id", *_NODE, "lo", "hi", F.lit(False).alias("leaf")), "inner")
    # The depth: inner nodes that begin before a node and have not ended, and those that begin with it and are larger.
    turns = inner.select("tree_id", F.col("lo").alias("at"), F.lit(1).alias("turn")).union(inner.select("tree_id", F.col("hi").alias("at"), F.lit(-1).alias("turn")))
    turns = turns.union(kept.select("tree_id", F.col("rank").alias("at"), F.lit(0).alias("turn"))).groupBy("tree_id", "at").agg(F.sum("turn").alias("turn"))
    turns = running(turns, ["tree_id"], "at", "turn", "open", inclusive=False).select("tree_id", F.col("at").alias("lo"), F.coalesce("open", F.lit(0)).alias("open"))
    starting = running(inner.select("tree_id", "lo", "node_id", "depth", F.lit(1).alias("one")), ["tree_id", "lo"], "depth", "one", "larger", inclusive=False).select("tree_id", "node_id", F.coalesce("larger", F.lit(0)).alias("larger"))
    whole = inner.groupBy("tree_id", "lo").agg(F.count("*").alias("all"))
    leaves = kept.select("tree_id", *_NODE, F.col("rank").alias("lo"), F.col("rank").alias("hi"), F.lit(True).alias("leaf"))
    both = inner.join(starting, ["tree_id", "node_id"]).unionByName(leaves.join(whole, ["tree_id", "lo"], "left").withColumn("larger", F.coalesce("all", F.lit(0))).drop("all"))
    both = both.join(turns, ["tree_id", "lo"])
    side = bounds.select("tree_id", "rank", F.struct("depth", "node_id", "root_dist").alias("up"))
    both = both.join(side.select("tree_id", (F.col("rank") + 1).alias("lo"), F.col("up").alias("left")), ["tree_id", "lo"], "left").join(side.select("tree_id", F.col("rank").alias("hi"), F.col("up").alias("right")), ["tree_id", "hi"], "left")
    both = both.withColumn("up", F.when(F.col("right").isNull() | (F.col("left.depth") >= F.col("right.depth")), F.col("left")).otherwise(F.col("right")))
    both = written(both, "both")
    top = both.where("up is null").select("tree_id", F.col("root_dist").alias("_top"))
    named = nodes.select("tree_id", "node_id", "name")
    out = both.join(top, "tree_id").join(named, ["tree_id", "node_id"])
    return out.select(
        "tree_id",
        "node_id",
        F.col("up.node_id").alias("parent_id"),
        "name",
        F.coalesce(F.col("root_dist") - F.col("up.root_dist"), F.lit(0.0)).alias("branch_length"),
        (F.col("open") + F.col("larger")).cast("int").alias("depth"),
        (F.col("root_dist") - F.col("_top")).alias("root_dist"),
        F.col("lo").cast("int").alias("lft"),
        F.col("hi").cast("int").alias("rgt"),
        F.col("leaf").alias("is_leaf"),
    )
