"""Stretches of reference sequences at many places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.session import written

#: Bases between the starts of two pieces, by level; a piece is twice as long, so that a stretch of up
#: to a step lies in one piece. Longer stretches are read from the whole sequence, the level behind these.
STEPS = (1 << 10, 1 << 15, 1 << 20)


def _pieces(seqs: DataFrame) -> DataFrame:
    """(sequence, _level, _piece, _bases) from (sequence, bases): about seven times the bases."""
    whole = len(STEPS)
    out = seqs.select("sequence", F.lit(whole).alias("_level"), F.lit(0).alias("_piece"), F.col("bases").alias("_bases"))
    for level, step in enumerate(STEPS):
        cut = seqs.select("sequence", F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_c"))
        both = F.zip_with("_c", F.slice("_c", F.lit(2), F.size("_c")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        out = out.union(cut.where("_c is not null").select("sequence", F.lit(level), F.posexplode(both)))
    return out


def with_bases(rows: DataFrame, seqs: DataFrame, position: Column, length: Column, name: str = "ref") -> DataFrame:
    """rows (sequence, ...) with `length` bases of seqs (sequence, bases) from `position` (from 1) on, less
    what lies beyond the end; rows of unknown sequences go.

    A row meets a piece about as long as what it asks for, never a whole sequence, whose places
    take a walk from its start each. The pieces are written to the shared folder.
    """
    pieces = written(_pieces(written(seqs.select("sequence", "bases"), "sequences")), "pieces")
    whole = len(STEPS)
    level, at, start = F.when(position < 1, whole), F.lit(0), position
    for i, step in enumerate(STEPS):
        level = level.when(length <= step, i)
    level = level.otherwise(whole)
    for i, step in enumerate(STEPS):
        at = F.when(level == i, F.floor((position - 1) / step).cast("int")).otherwise(at)
        start = F.when(level == i, (position - 1) % step + 1).otherwise(start)
    known = pieces.where(F.col("_level") == whole).select("sequence")
    asked = rows.withColumns({"_level": level, "_piece": at, "_start": start.cast("int"), "_length": length.cast("int")}).join(known, "sequence", "left_semi")
    # Sizes are told by compressed files here, so neither side is left to a broadcast.
    found = asked.join(pieces.hint("merge"), ["sequence", "_level", "_piece"], "left")
    bases = F.substring(F.coalesce("_bases", F.lit("")), F.col("_start"), F.col("_length"))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], bases.alias(name))
