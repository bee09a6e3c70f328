"""Annotation fields of variants and ranked picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.schema import ANNOTATION_TERMS, IMPACTS, UNKNOWN_TYPE


def ann_header(description: Column) -> Column:
    """Names from a description Functional annotations: 'a | b | ...'; anything else is an error."""
    body = F.regexp_extract(description, r"^Functional annotations: '(.*)'$", 1)
    names = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
    return F.when(description.startswith("Functional annotations: '"), names).otherwise(F.raise_error(F.concat(F.lit("not an ANN description: "), description)))


def explode_ann(variants: DataFrame, names: list[str], column: str = "ann", prefix: str = "") -> DataFrame:
    """One row an annotation of the array column, its fields by name; empty fields are null."""
    keys = [c for c in variants.columns if c != column]
    a = variants.select(*keys, F.explode(column).alias("_a")).withColumn("_p", F.split("_a", r"\|"))
    return a.select(*keys, *[F.nullif(F.get("_p", F.lit(i)), F.lit("")).alias(prefix + n) for i, n in enumerate(names)])


def cdna_split(cdna: Column) -> tuple[Column, Column]:
    p = F.split(cdna, "/")
    return F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")


def _rank(value: Column, names: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), value), F.lit(0))


def best_annotation(rows: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """One annotation a variant: strongest impact, strongest term, longest cDNA, then the tie columns.
    A term outside the fixed list ranks last and is null in the result."""
    term = _rank(F.col("annotation"), ANNOTATION_TERMS)
    w = Window.partitionBy(*keys).orderBy(_rank(F.col("impact"), IMPACTS).asc_nulls_last(), term.asc_nulls_last(), cdna_split(F.col("cdna"))[1].desc_nulls_last(), *ties)
    best = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.withColumn("annotation", F.when(term.isNotNull(), F.col("annotation")))


def with_best_annotation(variants: DataFrame, annotations: DataFrame) -> DataFrame:
    """Variants (variant_id, alt, ...) with their best annotation among those of the same allele, if any."""
    own = annotations.join(variants.select("variant_id", "alt").distinct(), "variant_id").where(F.col("Allele") == F.col("alt")).drop("alt")
    return variants.join(best_annotation(own, ["variant_id"], ["annotation", "cdna"]), "variant_id", "left")


def mask_precedence(calls: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One call a position: an unknown one beats any other, and of several calls the first stays."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("var_type") == UNKNOWN_TYPE, 0).otherwise(1), tie)
    return calls.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
