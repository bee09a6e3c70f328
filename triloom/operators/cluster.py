"""Cluster scores: how much of the clade below a sample set's MRCA the set makes up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators import paths

_KINDS = {}


def register_score_kind(name: str, score) -> None:
    """score(nodes, groups) gets leaf rows and (group, name) and returns (group, score)."""
    if name in _KINDS:
        raise ValueError(f"score kind {name} is registered")
    _KINDS[name] = score


def mrca_jaccard(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, tree_id, score): in each tree, the Jaccard index of a group and the leaves under its MRCA,
    which is that of its first and last leaf; a group without a leaf in any tree has none and scores NaN."""
    leaf = nodes.where("is_leaf").select("tree_id", "name", "lft")
    own = groups.select("group", "name").distinct()
    size = own.groupBy("group").agg(F.count("*").alias("n"))
    span = own.join(leaf, "name").groupBy("group", "tree_id").agg(F.min("lft").alias("lo"), F.max("lft").alias("hi"), F.count("*").alias("inside"))
    top = paths.common_ancestors(paths.chains(nodes), span).select("tree_id", "lo", "hi", (F.col("rgt") - F.col("lft") + 1).alias("below"))
    best = size.join(span.join(top, ["tree_id", "lo", "hi"]), "group", "left")
    score = F.when(F.col("inside") > 0, F.col("inside") / (F.col("below") + F.col("n") - F.col("inside"))).otherwise(F.lit(float("nan")))
    return best.select("group", "tree_id", score.cast("double").alias("score"))


register_score_kind("mrca_jaccard", mrca_jaccard)


def score_groupby(nodes: DataFrame, metadata: DataFrame, column: str, kind: str = "mrca_jaccard", min_samples: int | None = None, max_samples: int | None = None, na_value: str | None = None, group=None) -> DataFrame:
    """(group, samples, tree_id, score) for the values of a metadata column (name, column); null groups are
    left out unless na_value names them; groups are filtered by size before they are scored. group: a
    function of the Column. A registered kind without a tree_id gives none."""
    value = F.col(column).cast("string")
    value = F.coalesce(value, F.lit(na_value)) if na_value is not None else value
    m = metadata.select("name", (group(value) if group else value).alias("group")).where("group is not null").distinct()
    size = m.groupBy("group").agg(F.count("*").alias("samples"))
    size = size.where(F.col("samples") >= min_samples) if min_samples is not None else size
    size = size.where(F.col("samples") <= max_samples) if max_samples is not None else size
    return size.join(_KINDS[kind](nodes, m.join(size, "group", "left_semi")), "group")


def jensen_shannon(proportions: DataFrame) -> DataFrame:
    """(a, b, distance) for categories a < b from long (feature, category, p): the square root of the
    Jensen-Shannon divergence of the normalised columns, in nats."""
    total = proportions.groupBy("category").agg(F.sum("p").alias("t"))
    p = proportions.join(total, "category").select("feature", "category", (F.col("p") / F.col("t")).alias("p")).where("p > 0")
    x, y = p.select("feature", F.col("category").alias("a"), F.col("p").alias("pa")), p.select("feature", F.col("category").alias("b"), F.col("p").alias("pb"))
    # Where only one of the two has a feature, its term is p ln 2 / 2, so shared features suffice:
    # all terms sum to ln 2 less what the shared ones save.
    both = x.join(y, "feature").where("a < b")
    m = (F.col("pa") + F.col("pb")) / 2
    saved = (F.col("pa") * (F.lit(float(np.log(2))) - F.log(F.col("pa") / m)) + F.col("pb") * (F.lit(float(np.log(2))) - F.log(F.col("pb") / m))) / 2
    near = both.groupBy("a", "b").agg(F.sum(saved).alias("s"))
    names = total.select("category")
    pairs = names.select(F.col("category").alias("a")).join(names.select(F.col("category").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(near, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(F.lit(0.0), F.lit(float(np.log(2))) - F.coalesce("s", F.lit(0.0)))).alias("distance"))

