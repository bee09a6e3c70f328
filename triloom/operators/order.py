"""Running sums and minima over integer positions, in blocks, so that no task sorts a whole sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block; what is left for one task of a sequence is a row a block.
BLOCK = 4096


def running(rows: DataFrame, part: list[str], at: str, value: str, out: str, how: Callable = F.sum, inclusive: bool = True, backwards: bool = False) -> DataFrame:
    """rows with `out`: how (F.sum, F.min or F.max) of the values up to each row's position in its part, or
    from it on if backwards; without its own if not inclusive. One row a position; null where there is nothing.

    Blocks are summed up, the sums run over the blocks, and each block runs by itself.
    """
    block = F.floor(F.col(at) / BLOCK)
    order = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    blocked = rows.withColumn("_block", block)
    before = Window.partitionBy(*part).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*part, "_block").agg(how(value).alias("_all")).withColumn("_before", how("_all").over(before)).select(*part, "_block", "_before")
    inside = Window.partitionBy(*part, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = blocked.withColumn("_inside", how(value).over(inside)).join(blocks, [*part, "_block"])
    return both.withColumn(out, _join(how, F.col("_before"), F.col("_inside"))).drop("_block", "_before", "_inside")


def _join(how: Callable, a: Column, b: Column) -> Column:
    if how is F.min:
        return F.least(a, b)
    if how is F.max:
        return F.greatest(a, b)
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def covers(lo: Column, hi: Column) -> Column:
    """(level, block) of the few aligned blocks, of 2^level numbers each, that make up lo to hi."""
    return F.transform(
        F.array(F.struct(lo.cast("long").alias("lo"), (hi.cast("long") + 1).alias("end"))),
        lambda r: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.length(F.bin(F.greatest(r["end"] - r["lo"], F.lit(1))))),
                lambda j: F.transform(
                    F.array(F.struct(F.call_function("shiftright", r["lo"] + F.call_function("shiftleft", F.lit(1).cast("long"), j) - 1, j).alias("l"), F.call_function("shiftright", r["end"], j).alias("r"))),
                    lambda b: F.filter(
                        F.array(
                            F.when((b["l"] < b["r"]) & (b["l"] % 2 == 1), F.struct(j.alias("level"), b["l"].alias("block"))),
                            F.when((b["l"] < b["r"]) & (b["r"] % 2 == 1), F.struct(j.alias("level"), (b["r"] - 1).alias("block"))),
                        ),
                        lambda x: x.isNotNull(),
                    ),
                )[0],
            )
        ),
    )[0]


def in_blocks(rows: DataFrame, number: str, levels: Column) -> DataFrame:
    """rows with each aligned block (level, block) that holds their number, up to a level."""
    return rows.withColumn("level", F.explode(F.sequence(F.lit(0), levels))).withColumn("block", F.call_function("shiftright", F.col(number).cast("long"), F.col("level")))
