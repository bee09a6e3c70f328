"""A corpus pipeline of five stages over documents, each one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm import op03_exact_dedup, op04_language_id, op05_mixing, op08_minhash_dedup, op09_packing
from triloom.llm.common import Scratch, read, row_keys, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the table itself; only those without a letter
    and those that share no n-gram with any profile (score 0, so no language is told) go."""
    learning = docs.where(~op04_language_id.held_out(F.col("doc_id")))
    profiles = op04_language_id.learn(learning)
    own = {c: unused(docs.columns, f"_{c}")[0] for c in docs.columns if c.lower() in ("lang_pred", "score")}  # columns of that name stay as they are
    found = op04_language_id.identify(docs.withColumnsRenamed(own), profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id; rows count each by
    itself where a doc_id is repeated or null."""
    scratch = Scratch(spark)
    rows, key = row_keys(scratch, docs, nulls_first=True) or (docs, "doc_id")
    gone = op03_exact_dedup.duplicates(rows, scratch, ident=key).where("not kept").select(F.col("doc_id").alias(key))
    return rows.join(scratch.cut(gone, "gone"), key, "left_anti").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8), the one with the
    least doc_id; rows count each by itself where a doc_id is repeated or null."""
    scratch = Scratch(spark)
    rows, key = row_keys(scratch, docs) or (docs, "doc_id")
    found = op08_minhash_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80, scratch=scratch)
    gone = found.where("not kept").select(F.col("doc_id").alias(key))
    return rows.join(scratch.cut(gone, "gone"), key, "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times; rows count each by itself
    where a doc_id is repeated or null."""
    scratch = Scratch(spark)
    rows, key = row_keys(scratch, docs) or (docs, "doc_id")
    own, copies, nth = unused([*rows.columns], "_own", "_copies", "_nth")
    taken = op05_mixing.mix(rows.select(F.col(key).alias("doc_id"), "source", "text"), scratch=scratch).where("copies > 0")
    taken = scratch.cut(taken.select(F.col("doc_id").alias(own), F.col("copies").alias(copies)), "copies")
    # Both sides grow with the documents, so neither is ever broadcast.
    taken = rows.join(taken.hint("merge"), rows[key] == taken[own])
    taken = taken.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return taken.select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return op09_packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: No stage before the last can be told in SQL as a whole, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
