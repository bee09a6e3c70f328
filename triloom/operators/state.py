"""Three-valued (Kleene) algebra on state tables (sample_id, status): 0 absent, 1 unknown, 2 present.

The rows of a state are its universe. And is the lesser status, or the greater, not is 2 - status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.schema import ABSENT, PRESENT, UNKNOWN


def everything(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.lit(PRESENT).alias("status"))


def _both(a: DataFrame, b: DataFrame, pick) -> DataFrame:
    left, right = a.select("sample_id", F.col("status").alias("_a")), b.select("sample_id", F.col("status").alias("_b"))
    status = pick(F.coalesce("_a", F.lit(ABSENT)), F.coalesce("_b", F.lit(ABSENT)))
    return left.join(right, "sample_id", "full_outer").select("sample_id", status.alias("status"))


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, F.least)


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, F.greatest)


def not_(a: DataFrame) -> DataFrame:
    return a.select("sample_id", (F.lit(PRESENT) - F.col("status")).alias("status"))


def select(a: DataFrame, status: int) -> DataFrame:
    """The given class becomes present, the others absent; the universe stays."""
    return a.select("sample_id", F.when(F.col("status") == status, PRESENT).otherwise(ABSENT).alias("status"))


def restrict(a: DataFrame, chosen: DataFrame) -> DataFrame:
    """Statuses outside the chosen ids become absent; the universe stays."""
    ids = chosen.select("sample_id").distinct().withColumn("_in", F.lit(True))
    return a.join(ids, "sample_id", "left").select("sample_id", F.when(F.col("_in"), F.col("status")).otherwise(ABSENT).alias("status"))


def restrict_where(a: DataFrame, condition: Column) -> DataFrame:
    return a.select("sample_id", F.when(condition, F.col("status")).otherwise(ABSENT).alias("status"))


def and_status(a: DataFrame, found: DataFrame) -> DataFrame:
    """The lesser of a's status and a feature's; a sample the feature says nothing of is absent."""
    f = found.select("sample_id", F.col("status").alias("_f"))
    return a.join(f, "sample_id", "left").select("sample_id", F.least("status", F.coalesce("_f", F.lit(ABSENT))).alias("status"))


def reset_universe(a: DataFrame, include_unknown: bool = True) -> DataFrame:
    return a.where(F.col("status") >= (UNKNOWN if include_unknown else PRESENT))


def set_universe(a: DataFrame, universe: DataFrame | None) -> DataFrame:
    """The universe becomes that of the given ids (none: empty); new samples are absent."""
    if universe is None:
        return a.where(F.lit(False))
    ids = universe.select("sample_id").distinct()
    return ids.join(a, "sample_id", "left").select("sample_id", F.coalesce("status", F.lit(ABSENT)).alias("status"))


def subsample(a: DataFrame, k: float, include_unknown: bool = False, seed: int = 0) -> DataFrame:
    """k samples (k >= 1) or that share of them, rounded half to even, in order of a hash of seed and id."""
    if k is None or k < 0:
        raise ValueError("k must not be negative")
    pool = reset_universe(a, include_unknown).select("sample_id")
    n = pool.count()
    take = int(k) if k >= 1 else round(k * n)
    if k >= 1 and take > n:
        raise ValueError(f"k={k} is more than the {n} samples there are")
    # Whole buckets of the hash are taken up to the one that holds the last place; only that one, a
    # 65,536th of the samples, is sorted. The driver sees a count for each bucket.
    pool = pool.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string")))).withColumn("_b", F.substring("_key", 1, 4))
    left, cut = take, ""
    for r in sorted(pool.groupBy("_b").agg(F.count("*").alias("n")).collect()):
        cut = r["_b"]
        if r["n"] >= left:
            break
        left -= r["n"]
    last = pool.where(F.col("_b") == cut).orderBy("_key", "sample_id").limit(left)
    return restrict(a, pool.where(F.col("_b") < cut).union(last))


def counts(a: DataFrame, query: str = "") -> DataFrame:
    """One row: present, absent, unknown, total and their percents, null on an empty universe."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    c = a.agg(n(PRESENT).alias("present"), n(ABSENT).alias("absent"), n(UNKNOWN).alias("unknown"), F.count("*").alias("total"))
    share = lambda x: (F.try_divide(F.col(x).cast("double"), F.col("total").cast("double")) * 100.0).alias(f"percent_{x}")
    return c.select(F.lit(query).alias("query"), "*", share("present"), share("absent"), share("unknown"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (jaccard): shared over united ids of two id tables; NaN if both are empty."""
    left, right = a.select("sample_id").distinct().withColumn("_a", F.lit(1)), b.select("sample_id").distinct().withColumn("_b", F.lit(1))
    both = left.join(right, "sample_id", "full_outer").agg(F.sum(F.col("_a") * F.col("_b")).alias("i"), F.count("*").alias("u"))
    return both.select(F.coalesce(F.try_divide(F.coalesce("i", F.lit(0)).cast("double"), F.col("u").cast("double")), F.lit(float("nan"))).alias("jaccard"))
