"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to get the same number of copies, target / size of the source. The
documents are rounded in three classes of size, largest first, and a class takes the probability
that makes up for what those before it missed, so the copies of smaller documents depend on those
draws; the expectation is exact in the first class and close to it in the others.
A fraction is rounded in pairs: two documents move mass between each other in a random direction,
with the words they stand for kept in sum, until one of them is integral. Each block of a source
leaves at most one fractional document, and these residuals meet in a reduction tree of blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.llm.common import WORD, Scratch

#: Rows of a block on the lowest level (about), and blocks that meet in one on each level above.
BLOCK, FAN_IN = 4096, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, docs, source_size, target from rows (source, size).

    Sources are ordered by code point, null last, and weigh 1, 2, 3 and so on again. They share
    the total of all sizes; a target stops at `most` times its source's size and the excess is
    reshared by weight until none is above. That is water filling: in order of most * size /
    weight, a source is capped if and only if its cap is below its share of what the sources before
    it leave. One row a source: the two windows run over the sources, not over documents.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(everything).cast("double"), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "wrest": F.sum("w").over(after)})
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("wrest"))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # The level of the first source that is not capped holds for all behind it.
    s = s.withColumn("water", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything))
    return s.select("source", "docs", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


_STATE = "source string, block long, doc_id long, size long, copies long, p double"


def _pivot(seed: int, level: int, last: bool, nearest: bool):
    """Rounds one block: descending sizes, one fractional document carried along. On the last level
    the residual of a source goes to the nearer integer, or is drawn if a later class makes up for it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable").reset_index(drop=True)
        first = rows.iloc[0]
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(first["source"]).encode()), int(first["block"])])
        size, p, copies = rows["size"].to_numpy("f8"), rows["p"].to_numpy("f8").copy(), rows["copies"].to_numpy("i8").copy()
        u, carry = rng.random(len(rows)), -1
        for i in range(len(rows)):
            if carry < 0:
                carry = i
                continue
            j, a, b = carry, size[carry], size[i]
            up, down = min(1 - p[j], p[i] * b / a), min(p[j], (1 - p[i]) * b / a)
            if u[i] * (up + down) < down:  # j gains
                whole = up == 1 - p[j]
                p[j], p[i] = (1.0, p[i] - up * a / b) if whole else (p[j] + up, 0.0)
            else:
                whole = down == p[j]
                p[j], p[i] = (0.0, p[i] + down * a / b) if whole else (p[j] - down, 1.0)
            near = [k for k in (j, i) if 1e-12 < p[k] < 1 - 1e-12]
            for k in (j, i):
                if k not in near:
                    p[k] = round(p[k])
            carry = near[0] if near else -1
        if carry >= 0 and last:
            p[carry] = float(p[carry] >= (0.5 if nearest else rng.random()))
            carry = -1
        done = np.ones(len(rows), bool)
        if carry >= 0:
            done[carry] = False
        copies[done] += p[done].astype("i8")
        rows["copies"], rows["p"] = copies, pd.array(np.where(done, 0, p), dtype="Float64")
        rows.loc[done, "p"] = pd.NA
        return rows

    return run


def _size_class(size: Column, mean: Column) -> Column:
    """0: over four times its source's mean, 1: over a quarter of it, 2: the rest."""
    return F.when(size > 4 * mean, 0).when(size * 4 > mean, 1).otherwise(2)


def _round(scratch: Scratch, rows: DataFrame, most_docs: int, seed: int, final: bool) -> DataFrame:
    """(source, doc_id, size, copies) with whole copies, by the tree of blocks."""
    whole = (F.col("p") <= 0) | (F.col("size") == 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("docs") / BLOCK))).drop("docs")
    settled = [rows.where(whole)]
    pending, blocks, level = rows.where(~whole), max(1, -(-most_docs // BLOCK)), 0
    while True:
        state = pending.groupBy("source", "block").applyInPandas(_pivot(seed, level, blocks == 1, final), _STATE)
        state = scratch.cut(state, f"level{level}")
        settled.append(state.where("p is null"))
        if blocks == 1:
            break
        pending = state.where("p is not null").withColumn("block", F.floor(F.col("block") / FAN_IN))
        blocks, level = -(-blocks // FAN_IN), level + 1
    out = settled[0].select("source", "doc_id", "size", "copies")
    for part in settled[1:]:
        out = out.union(part.select(out.columns))
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: the whole copies of each document in the mix.

    size counts the words of the text (null: 0). No document has more than `most` copies. The
    documents far above their source's mean size are rounded first and the smallest last; each
    class gets the copy probability that makes up for what the class before it missed, so the
    error that stays is at most half of a small document where there are any. Reruns agree: the
    draws depend on the seed and the rows only. Each row counts by itself where rows repeat a
    doc_id; rows alike in doc_id, source and size are interchangeable. Documents without words
    take none. A null source is a source of its own. An empty table gives no rows; other columns
    are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sized = scratch.cut(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    targets = scratch.cut(source_targets(sized, weights, most), "targets")
    most_docs = targets.agg(F.max("docs")).first()[0] or 0
    rest = targets.select("source", "docs", (F.col("source_size") / F.col("docs")).alias("mean"), F.col("target").alias("left"), F.col("source_size").alias("open"))
    done = None
    for k in range(3):
        r = rest.withColumnRenamed("source", "_s")
        share = F.when(F.col("open") > 0, F.least(F.greatest(F.col("left") / F.col("open"), F.lit(0.0)), F.lit(float(most)))).otherwise(F.lit(0.0))
        rows = sized.join(r, sized["source"].eqNullSafe(F.col("_s"))).where(_size_class(F.col("size"), F.col("mean")) == k)
        rows = rows.select("source", "doc_id", "size", "docs", F.floor(share).alias("copies"), (share - F.floor(share)).alias("p"))
        part = _round(scratch, rows, most_docs, seed + k, k > 0)
        done = part if done is None else done.union(part)
        if k < 2:
            used = part.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.sum("size").alias("had"))
            rest = rest.join(used, rest["source"].eqNullSafe(F.col("_s")), "left")
            rest = rest.select("source", "docs", "mean", (F.col("left") - F.coalesce("took", F.lit(0))).alias("left"), (F.col("open") - F.coalesce("had", F.lit(0))).alias("open"))
            rest = scratch.cut(rest, "rest")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return done.join(t, done["source"].eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
