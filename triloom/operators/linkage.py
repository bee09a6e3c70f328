"""Single linkage by Boruvka rounds over the pairs of samples that have a distance at all.

Every round takes each cluster's least edge to another one, joins the clusters along them and drops
the edges inside; there are log n rounds at most. Nothing is square: pairs without an entry are at
distance FAR, and one such edge a cluster is enough to tie what is left together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.session import written

FAR = 1.0


def _roots(next_: DataFrame) -> DataFrame:
    """(cluster, root) from (cluster, to), where least edges lead in circles of two at most."""
    back = next_.select(F.col("cluster").alias("to"), F.col("to").alias("_back"))
    jump = next_.join(back, "to", "left").select("cluster", F.when((F.col("_back") == F.col("cluster")) & (F.col("cluster") < F.col("to")), F.col("cluster")).otherwise(F.col("to")).alias("root"))
    jump = written(jump, "roots")
    while True:
        far = jump.select(F.col("cluster").alias("root"), F.col("root").alias("_far"))
        new = written(jump.join(far, "root").select("cluster", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("moved")), "roots")
        jump = new.drop("moved")
        if new.where("moved").isEmpty():
            return jump


def spanning_edges(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_a, sample_b, distance): the least spanning tree of the samples (sample_id), from pairs
    (sample_a, sample_b, distance) without self pairs; of edges of one length the least ids come first."""
    edges = pairs.select("sample_a", "sample_b", "distance", F.col("sample_a").alias("ca"), F.col("sample_b").alias("cb"))
    cluster = written(samples.select("sample_id", F.col("sample_id").alias("cluster")).distinct(), "clusters")
    tree: DataFrame | None = None
    while True:
        # Of the edges between two clusters the least one is enough.
        low, high = F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")
        edges = edges.where("ca <> cb").groupBy(low, high).agg(F.min(F.struct("distance", "sample_a", "sample_b")).alias("e"))
        edges = written(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.select(F.col("ca").alias("cluster"), F.col("cb").alias("to"), "e").union(edges.select("cb", "ca", "e"))
        least = written(both.groupBy("cluster").agg(F.min(F.struct("e.distance", "e.sample_a", "e.sample_b", "to")).alias("m")).select("cluster", "m.*"), "least")
        new = least.select("sample_a", "sample_b", "distance").distinct()
        tree = new if tree is None else tree.union(new)
        root = _roots(least.select("cluster", "to"))
        cluster = written(cluster.join(root, "cluster", "left").select("sample_id", F.coalesce("root", "cluster").alias("cluster")), "clusters")
        ra, rb = root.select(F.col("cluster").alias("ca"), F.col("root").alias("_ra")), root.select(F.col("cluster").alias("cb"), F.col("root").alias("_rb"))
        edges = edges.join(ra, "ca").join(rb, "cb").select("e.sample_a", "e.sample_b", "e.distance", F.col("_ra").alias("ca"), F.col("_rb").alias("cb"))
    lone = cluster.groupBy("cluster").agg(F.min("sample_id").alias("sample_b"))
    first = lone.agg(F.min("sample_b")).scalar()
    tied = lone.select(first.alias("sample_a"), "sample_b", F.lit(FAR).alias("distance")).where("sample_a <> sample_b")
    return tied if tree is None else tree.union(tied)


def leaf_heights(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, height) at which each sample joins another one: half its least edge, 0 for a lone sample."""
    ends = edges.select(F.col("sample_a").alias("sample_id"), "distance").union(edges.select("sample_b", "distance"))
    return samples.select("sample_id").distinct().join(ends.groupBy("sample_id").agg((F.min("distance") / 2).alias("height")), "sample_id", "left").select("sample_id", F.coalesce("height", F.lit(0.0)).alias("height"))
