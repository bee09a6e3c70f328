"""Feature summaries, contrasts and comparisons over selected samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions.ids import percent, sanitize_name
from triloom.schema import UNKNOWN_ALLELE, UNKNOWN_TYPE

MUTATION_COLUMNS = ["sequence", "position", "deletion", "insertion", "var_type"]
MLST_COLUMNS = ["scheme", "locus", "allele"]


def variant_features(calls: DataFrame, include_present: bool = True, include_unknown: bool = False) -> DataFrame:
    unknown = F.col("var_type") == UNKNOWN_TYPE
    return calls.where((~unknown & F.lit(include_present)) | (unknown & F.lit(include_unknown)))


def mlst_features(mlst: DataFrame, include_present: bool = True, include_unknown: bool = False, scheme: str | None = None, locus: str | None = None) -> DataFrame:
    unknown = F.col("allele") == UNKNOWN_ALLELE
    out = mlst.where((~unknown & F.lit(include_present)) | (unknown & F.lit(include_unknown)))
    if scheme:
        out = out.where(F.col("scheme") == scheme)
    return out.where(F.col("locus") == locus) if locus else out


#: Sample ids of a row of sample_lists are alike but for so many bits.
IDS = 16


def sample_lists(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, columns, block, n, samples): the whole sample set of each feature, ids in order between commas.
    A set has a row for each block of 2^IDS ids, so that a row is bounded; a repeated id counts once."""
    block = F.shiftright(F.col("sample_id").cast("long"), IDS).alias("block")
    sets = features.select("feature", *columns, "sample_id", block).groupBy("feature", *columns, "block").agg(F.sort_array(F.collect_set("sample_id")).alias("_s"))
    return sets.select("feature", *columns, "block", F.size("_s").cast("long").alias("n"), F.array_join(F.col("_s").cast("array<string>"), ",").alias("samples"))


def summary(features: DataFrame, columns: list[str], selected: DataFrame | None, total: Column, unknown: DataFrame | None = None, no_present: bool = False) -> DataFrame:
    """One row a feature: columns, count, [unknown counts,] total and percents.

    features: long (feature, columns, sample_id), one row a pair. selected: ids, or None for all
    samples (no join at all). unknown: (feature, sample_id) pairs; a sample that is both found and
    unknown counts as unknown. Features that no selected sample has are left out, unless no_present
    asks for those with unknown samples.
    """
    rows = features if selected is None else features.join(selected.select("sample_id"), "sample_id", "left_semi")
    if unknown is None:
        out = rows.groupBy("feature", *columns).agg(F.count("*").alias("count"))
        return out.withColumn("total", total).withColumn("percent", percent(F.col("count"), F.col("total")))
    names = features.select("feature", *columns).distinct()
    unk = unknown if selected is None else unknown.join(selected.select("sample_id"), "sample_id", "left_semi")
    marks = rows.select("feature", "sample_id", F.lit(0).alias("u")).union(unk.join(names.select("feature"), "feature", "left_semi").select("feature", "sample_id", F.lit(1)))
    pairs = marks.groupBy("feature", "sample_id").agg(F.max("u").alias("u"))
    out = pairs.groupBy("feature").agg(F.sum(1 - F.col("u")).alias("count"), F.sum("u").alias("unknown_count")).where("count > 0" + (" or unknown_count > 0" if no_present else ""))
    out = names.join(out.withColumns({"count": F.col("count").cast("long"), "unknown_count": F.col("unknown_count").cast("long")}), "feature")
    out = out.withColumn("present_and_unknown_count", F.col("count") + F.col("unknown_count")).withColumn("total", total)
    for c in ("", "unknown_", "present_and_unknown_"):
        out = out.withColumn(f"{c}percent", percent(F.col(f"{c}count"), F.col("total")))
    return out


def unique_summary(chosen: DataFrame, other: DataFrame) -> DataFrame:
    """The chosen samples' features that none of the others has."""
    return chosen.join(other.select("feature"), "feature", "left_anti")


def comparison(
    features: DataFrame, columns: list[str], categories: DataFrame, names: list[str], unit: str = "percent", selected: DataFrame | None = None, unknown: DataFrame | None = None, threshold: int | None = None, only_categories: bool = True
) -> DataFrame:
    """One row a feature; for each category {c}_{unit}, {c}_total and, with unknown pairs,
    {c}_Unknown {unit} and {c}_Present and Unknown {unit}; and Total.

    categories: (sample_id, category), may overlap; categories below threshold samples are dropped.
    An empty category has null shares and zero counts. One join and one conditional aggregation.
    """
    cats = categories.distinct() if selected is None else categories.distinct().join(selected.select("sample_id"), "sample_id", "left_semi")
    sizes = {r["category"]: r["n"] for r in cats.groupBy("category").agg(F.count("*").alias("n")).collect()}
    names = [n for n in names if threshold is None or sizes.get(n, 0) >= threshold]
    cats = cats.where(F.col("category").isin(names))
    pool = cats.select("sample_id").distinct() if only_categories else selected
    total = pool.count()
    member = cats.groupBy("sample_id").agg(F.collect_set("category").alias("cats"))
    # The id determines the columns, so they go along where nothing else is united with the features.
    along = columns if unknown is None else []
    marks = features.select("feature", *along, "sample_id", F.lit(0).alias("u"))
    if unknown is not None:
        marks = marks.union(unknown.join(features.select("feature").distinct(), "feature", "left_semi").select("feature", "sample_id", F.lit(1)))
        marks = marks.groupBy("feature", "sample_id").agg(F.max("u").alias("u"))
    rows = marks.join(pool, "sample_id", "left_semi").join(member, "sample_id", "left")
    count = lambda c, u: F.sum((F.coalesce(F.array_contains("cats", c), F.lit(False)) & (F.col("u") == u)).cast("long"))
    aggs = [F.sum(1 - F.col("u")).alias("_present")]
    for i, n in enumerate(names):
        aggs += [count(n, 0).alias(f"_p{i}"), count(n, 1).alias(f"_u{i}")]
    out = rows.groupBy("feature", *along).agg(*aggs).where("_present > 0")
    factor = {"percent": 100.0, "proportion": 1.0, "count": None}[unit]

    def value(c: Column, n: str) -> Column:
        return c if factor is None else F.try_divide(c.cast("double"), F.lit(float(sizes.get(n, 0)))) * factor

    cols = [F.lit(total).cast("long").alias("Total")]
    for i, n in enumerate(names):
        cols.append(value(F.col(f"_p{i}"), n).alias(f"{n}_{unit}"))
        if unknown is not None:
            cols += [value(F.col(f"_u{i}"), n).alias(f"{n}_Unknown {unit}"), value(F.col(f"_p{i}") + F.col(f"_u{i}"), n).alias(f"{n}_Present and Unknown {unit}")]
        cols.append(F.lit(sizes.get(n, 0)).cast("long").alias(f"{n}_total"))
    if unknown is None:
        return out.select("feature", *cols, *along)
    return out.select("feature", *cols).join(features.select("feature", *columns).distinct(), "feature")


def restore_names(rows: DataFrame, safe: str, names: DataFrame, column: str) -> DataFrame:
    """rows with the names (column) that their sanitised forms (safe) stand for. Names that share a form
    are both given; the join is left to choose its side by size."""
    known = names.select(column).distinct().withColumn(safe, sanitize_name(F.col(column)))
    return rows.join(known, safe)
