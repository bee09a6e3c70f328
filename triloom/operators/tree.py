"""Rooted trees: newick, nested-set tables, MRCA, distances, pruning, and tree building on the driver.

A tree has at most one leaf a sample, so parsing and reshaping run on the driver; what relates
leaves to samples runs as joins on the nested-set numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triloom.operators import paths
from triloom.schema import TREE_NODES
from triloom.session import written


@dataclass
class Node:
    name: str | None = None
    length: float = 0.0
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.children:
                todo += reversed(n.children)
            else:
                out.append(n)
        return out

    def leaf_names(self) -> list[str]:
        return [n.name for n in self.leaves()]


_TOKEN = re.compile(r"\s*(?:\[[^\]]*\]\s*)*('(?:[^']|'')*'|[(),;:]|[^(),;:\s\[]+)")  # comments are skipped, quotes kept


def parse_newick(text: str) -> Node:
    """The tree of a newick string; inner labels and supports become names."""
    tokens = _TOKEN.findall(text)
    root = Node()
    at, path, i = root, [], 0
    while i < len(tokens):
        t = tokens[i]
        if t == "(":
            path.append(at)
            at.children.append(Node())
            at = at.children[-1]
        elif t == ",":
            path[-1].children.append(Node())
            at = path[-1].children[-1]
        elif t == ")":
            at = path.pop()
        elif t == ":":
            i += 1
            at.length = float(tokens[i])
        elif t == ";":
            break
        else:
            at.name = t[1:-1].replace("''", "'") if t.startswith("'") else t
        i += 1
    if path:
        raise ValueError("unbalanced newick")
    return root


def _number(x: float) -> str:
    return f"{x:.12g}"


def to_newick(root: Node) -> str:
    def quoted(n: str | None) -> str:
        return "" if n is None else n if re.fullmatch(r"[^\s(),:;'\[\]]+", n) else "'" + n.replace("'", "''") + "'"

    done: dict[int, str] = {}
    todo = [(root, False)]
    while todo:
        n, ready = todo.pop()
        if n.children and not ready:
            todo.append((n, True))
            todo += [(c, False) for c in n.children]
            continue
        inner = "(" + ",".join(done.pop(id(c)) for c in n.children) + ")" if n.children else ""
        done[id(n)] = inner + quoted(n.name) + ("" if n is root else f":{_number(n.length)}")
    return done[id(root)] + ";"


def node_rows(root: Node, tree_id: str = "tree") -> list[tuple]:
    """Rows of the nested-set table: lft and rgt number the leaves below, from 1."""
    order, todo = [], [(root, -1, 0, 0.0)]
    while todo:
        n, parent, depth, dist = todo.pop()
        me = len(order)
        order.append([n, parent, depth, dist, None, None])
        todo += [(c, me, depth + 1, dist + c.length) for c in reversed(n.children)]
    leaf = 0
    for r in order:
        if not r[0].children:
            leaf += 1
            r[4] = r[5] = leaf
    for i in range(len(order) - 1, 0, -1):
        p = order[order[i][1]]
        p[4] = order[i][4] if p[4] is None else min(p[4], order[i][4])
        p[5] = order[i][5] if p[5] is None else max(p[5], order[i][5])
    return [(tree_id, i, None if p < 0 else p, n.name, float(n.length), d, float(x), lo, hi, not n.children) for i, (n, p, d, x, lo, hi) in enumerate(order)]


def tree_nodes(spark: SparkSession, root: Node, tree_id: str = "tree") -> DataFrame:
    return spark.createDataFrame(node_rows(root, tree_id), TREE_NODES)


def mrca(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(tree_id, lft, rgt, root_dist) of the deepest node over all anchors (name); none without an anchor."""
    a = nodes.where("is_leaf").join(anchors.select("name").distinct(), "name", "left_semi").groupBy("tree_id").agg(F.min("lft").alias("lo"), F.max("lft").alias("hi"))
    over = nodes.join(a, "tree_id").where((F.col("lft") <= F.col("lo")) & (F.col("rgt") >= F.col("hi")))
    best = over.groupBy("tree_id").agg(F.max_by(F.struct("lft", "rgt", "root_dist"), F.struct("depth", "node_id")).alias("n"))
    return best.select("tree_id", "n.*")


def leaves_below(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """Leaf names under the nodes (tree_id, lft, rgt)."""
    t = top.select("tree_id", F.col("lft").alias("_lo"), F.col("rgt").alias("_hi"))
    return nodes.where("is_leaf").join(t, "tree_id").where("lft between _lo and _hi").select("name").distinct()


def distances(nodes: DataFrame, anchors: DataFrame, chunk: int = 1 << 10) -> DataFrame:
    """(anchor, name, distance) of every leaf to every anchor: root_dist of both less twice that of
    their last common ancestor. The ancestors of an anchor cut the leaves into ranges, two for each
    ancestor: those below it and not below the next. Leaves lie in blocks of neighbouring numbers, one row
    each; ranges are cut at their ends and meet them by an equal join, so that pairs of the result are
    made last and are not shuffled. Parts of less than an eighth of a block meet leaf by leaf instead."""
    nodes = written(nodes, "nodes")
    leaf = nodes.where("is_leaf").select("tree_id", "name", "lft", "root_dist")
    a = leaf.join(anchors.select("name").distinct(), "name", "left_semi").select("tree_id", F.col("name").alias("anchor"), F.col("lft").alias("al"), F.col("root_dist").alias("ad"))
    above = paths.ancestors_of(paths.chains(nodes), a.select("tree_id", F.col("al").alias("leaf")))
    above = above.select("tree_id", F.col("leaf").alias("al"), F.col("lft").alias("nl"), F.col("rgt").alias("nr"), F.col("root_dist").alias("nd"), "depth")
    w = Window.partitionBy("tree_id", "anchor").orderBy(F.col("depth").desc())
    up = a.join(above, ["tree_id", "al"]).withColumns({"bl": F.lag("nl").over(w), "br": F.lag("nr").over(w)})
    whole = F.array(F.struct(F.col("nl").alias("lo"), F.col("nr").alias("hi")))
    sides = F.array(F.struct(F.col("nl").alias("lo"), (F.col("bl") - 1).alias("hi")), F.struct((F.col("br") + 1).alias("lo"), F.col("nr").alias("hi")))
    parts = up.select("tree_id", "anchor", "ad", "nd", F.explode(F.when(F.col("bl").isNull(), whole).otherwise(sides)).alias("r")).where("r.lo <= r.hi")
    parts = written(parts, "ranges")  # a few for each anchor
    at = lambda x: F.floor(F.col(x) / chunk)
    parts = parts.select("tree_id", "anchor", "ad", "nd", "r.lo", "r.hi", F.explode(F.sequence(at("r.lo"), at("r.hi"))).alias("block"))
    first = F.col("block") * chunk
    parts = parts.withColumns({"lo": F.greatest("lo", first), "hi": F.least("hi", first + chunk - 1)})
    short = F.col("hi") - F.col("lo") + 1 < chunk // 8
    distance = lambda own: (F.col("ad") + own - 2 * F.col("nd")).alias("distance")
    few = parts.where(short).withColumn("lft", F.explode(F.sequence("lo", "hi"))).join(leaf.hint("merge"), ["tree_id", "lft"]).select("anchor", "name", distance(F.col("root_dist")))
    # A task for each block, as many as there are: few rows meet, and make many.
    n = min(max(leaf.count() // chunk, 1), 4096)
    held = leaf.withColumn("block", at("lft")).repartition(n, "tree_id", "block").groupBy("tree_id", "block").agg(F.collect_list(F.struct("lft", "name", "root_dist")).alias("leaves"))
    many = parts.where(~short).repartition(n, "tree_id", "block").join(held.hint("merge"), ["tree_id", "block"]).select("anchor", "ad", "nd", "lo", "hi", F.explode("leaves").alias("leaf"))
    return few.union(many.where("leaf.lft between lo and hi").select("anchor", "leaf.name", distance(F.col("leaf.root_dist"))))


def from_nodes(nodes: DataFrame) -> Node:
    """A table of one tree as a tree on the driver."""
    rows = nodes.select("node_id", "parent_id", "name", "branch_length").orderBy("lft", "depth").collect()
    made = {r["node_id"]: Node(r["name"], r["branch_length"]) for r in rows}
    root = Node()
    for r in rows:
        if r["parent_id"] is None:
            root = made[r["node_id"]]
        else:
            made[r["parent_id"]].children.append(made[r["node_id"]])
    return root


# Driver-side reshaping; without recursion, as trees may be as deep as they have leaves.


def _rebuilt(root: Node, make) -> Node | None:
    """A new tree from the bottom up: make(node, new children) gives a node's successor or None."""
    made: dict[int, Node | None] = {}
    todo = [(root, False)]
    while todo:
        n, ready = todo.pop()
        if n.children and not ready:
            todo.append((n, True))
            todo += [(c, False) for c in n.children]
        else:
            made[id(n)] = make(n, [k for c in n.children if (k := made.pop(id(c))) is not None])
    return made[id(root)]


def prune(root: Node, keep: set[str], preserve_length: bool = True) -> Node | None:
    """The tree of the kept leaves, a new one; nodes with one child are merged, their lengths summed if asked."""
    def make(n: Node, kids: list[Node]) -> Node | None:
        if not n.children:
            return Node(n.name, n.length) if n.name in keep else None
        if len(kids) == 1:
            kids[0].length += n.length if preserve_length else 0
            return kids[0]
        return Node(n.name, n.length, kids) if kids else None

    out = _rebuilt(root, make)
    if out is not None:
        out.length = 0.0
    return out


def set_outgroup(root: Node, leaf: str) -> Node:
    """Re-rooted halfway along the branch above the leaf; a node that is left with one child is merged."""
    above: dict[int, Node] = {}
    todo, target = [root], None
    while todo:
        n = todo.pop()
        for c in n.children:
            above[id(c)] = n
        todo += n.children
        target = n if not n.children and n.name == leaf else target
    if target is None or target is root:
        raise ValueError(f"no leaf {leaf}")
    # From the old root down to the leaf, each node becomes a child of the next one below it.
    path = [target]
    while path[-1] is not root:
        path.append(above[id(path[-1])])
    rest: Node | None = None
    for n, below in zip(reversed(path[1:]), reversed(path[:-1]), strict=True):
        kids = [_rebuilt(c, lambda x, k: Node(x.name, x.length, k)) for c in n.children if c is not below]
        kids += [rest] if rest is not None else []
        if len(kids) == 1:
            rest = kids[0]
            rest.length += below.length
        else:
            rest = Node(n.name, below.length, kids)
    rest.length -= target.length / 2
    return Node(None, 0.0, [Node(target.name, target.length / 2), rest])


def relabel(root: Node, rename) -> Node:
    return _rebuilt(root, lambda n, kids: Node(rename(n.name) if not kids and n.name else n.name, n.length, kids))


def label_internal(root: Node, label) -> Node:
    """Inner nodes named by a function of the sorted leaf names below each."""
    names: dict[int, list[str]] = {}

    def make(n: Node, kids: list[Node]) -> Node:
        out = Node(n.name, n.length, kids)
        names[id(out)] = sorted(x for k in kids for x in names.pop(id(k))) if kids else [n.name or ""]
        if kids:
            out.name = label(names[id(out)])
        return out

    return _rebuilt(root, make)


def single_linkage(labels: list[str], matrix: np.ndarray) -> Node:
    """The dendrogram of single linkage: the minimum spanning tree's edges, shortest first, join
    clusters; a leaf is half of its merge height from its parent."""
    n = len(labels)
    if n == 0:
        raise ValueError("no samples")
    # Prim's spanning tree: n steps of one row each.
    near, via, out = np.array(matrix[0], float), np.zeros(n, np.intp), np.ones(n, bool)
    out[0] = False
    edges = []
    for _ in range(n - 1):
        j = int(np.where(out, near, np.inf).argmin())
        edges.append((float(near[j]), *sorted((int(via[j]), j))))
        out[j] = False
        closer = out & (matrix[j] < near)
        near[closer], via[closer] = matrix[j][closer], j
    return dendrogram(labels, edges)


def dendrogram(labels: list[str], edges: list[tuple[float, int, int]]) -> Node:
    """The tree whose clusters the edges (distance, i, j) of a spanning tree join, shortest first."""
    n, edges = len(labels), sorted(edges)
    if n == 0:
        raise ValueError("no samples")
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    made, height = {i: Node(labels[i]) for i in range(n)}, dict.fromkeys(range(n), 0.0)
    for d, i, j in edges:
        a, b = root(i), root(j)
        made[a].length, made[b].length = d / 2 - height[a], d / 2 - height[b]
        made[a], height[a], parent[b] = Node(None, 0.0, [made[a], made[b]]), d / 2, a
    return made[root(0)]


def neighbour_joining(labels: list[str], matrix: np.ndarray) -> Node:
    """Neighbour joining on a distance matrix; the last three nodes meet in the root."""
    nodes, d = [Node(x) for x in labels], np.array(matrix, float)
    while len(nodes) > 3:
        n = len(nodes)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = np.unravel_index(q.argmin(), q.shape)
        li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        nodes[i].length, nodes[j].length = max(0.0, li), max(0.0, d[i, j] - li)
        new = (d[i] + d[j] - d[i, j]) / 2
        rest = [k for k in range(n) if k not in (i, j)]
        nodes = [nodes[k] for k in rest] + [Node(None, 0.0, [nodes[i], nodes[j]])]
        d = np.block([[d[np.ix_(rest, rest)], new[rest][:, None]], [new[rest][None, :], np.zeros((1, 1))]])
    if len(nodes) == 3:
        a, b, c = d[0, 1], d[0, 2], d[1, 2]
        for node, x in zip(nodes, ((a + b - c) / 2, (a + c - b) / 2, (b + c - a) / 2), strict=True):
            node.length = max(0.0, x)
    elif len(nodes) == 2:
        nodes[0].length = nodes[1].length = d[0, 1] / 2
    return Node(None, 0.0, nodes) if len(nodes) > 1 else nodes[0]
