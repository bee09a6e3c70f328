"""Interval (mask) algebra on tables (keys..., start0, end0), 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sequence"]


#: Positions of a span: spans are merged and swept side by side.
_SPAN = 1 << 16


def _islands(a: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start0", "end0")
    before = F.max("end0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start0") > before), 1).otherwise(0)
    island = a.select(*keys, "start0", "end0").withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return island.groupBy(*keys, "_island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("_island")


def _cut(a: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals cut where a span ends, with their span (_span)."""
    spans = F.sequence(F.floor(F.col("start0") / _SPAN), F.floor(F.greatest(F.col("start0"), F.col("end0") - 1) / _SPAN))
    t = a.select(*keys, "start0", "end0", F.explode(spans).alias("_span"))
    lo = F.col("_span") * _SPAN
    return t.select(*keys, F.greatest(F.col("start0"), lo).alias("start0"), F.least(F.col("end0"), lo + _SPAN).alias("end0"), "_span")


def _span_islands(a: DataFrame, keys: list[str]) -> DataFrame:
    """Islands within spans. Where no sample is among the keys, a span may have the intervals of all samples:
    of those that start in one place the longest is enough, so that a task sorts _SPAN rows a span at most."""
    span, t = [*keys, "_span"], _cut(a, keys)
    if keys == KEYS:
        t = t.groupBy(*span, "start0").agg(F.max("end0").alias("end0")).select(*keys, "start0", "end0", "_span")
    return _islands(t, span)


def _joined(t: DataFrame, keys: list[str]) -> DataFrame:
    """Islands of spans joined over span ends. Only those that touch an end meet in one task a sequence:
    two a span at most, whatever the number of intervals."""
    inside = (F.col("start0") > F.col("_span") * _SPAN) & (F.col("end0") < (F.col("_span") + 1) * _SPAN)
    return _islands(t.withColumn("_part", F.when(inside, F.col("_span"))), [*keys, "_part"]).drop("_part")


def merge(a: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sorted, with overlapping and bookended intervals merged: a running end starts islands, span by span."""
    return _joined(_span_islands(a, keys), keys)


def _sweep(a: DataFrame, b: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Segments between neighbouring boundaries of a and b where keep holds of the coverages _a and _b,
    merged. One sort a span whatever the overlaps: no pair of intervals is formed."""
    span = [*keys, "_span"]

    def ends(t: DataFrame, x: int, y: int) -> DataFrame:
        return t.select(*span, F.explode(F.array(F.struct(F.col("start0").alias("at"), F.lit(x).alias("da"), F.lit(y).alias("db")), F.struct(F.col("end0").alias("at"), F.lit(-x).alias("da"), F.lit(-y).alias("db")))).alias("e")).select(*span, "e.*")

    points = ends(_span_islands(a, keys), 1, 0).union(ends(_span_islands(b, keys), 0, 1)).groupBy(*span, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*span).orderBy("at")
    seg = points.select(*span, F.col("at").alias("start0"), F.lead("at").over(w).alias("end0"), F.sum("da").over(w).alias("_a"), F.sum("db").over(w).alias("_b"))
    return _joined(_islands(seg.where(keep & F.col("end0").isNotNull()), span), keys)


def coverage(a: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, start0, end0, n): segments between neighbouring boundaries with the number of intervals over them,
    where there are any; repeated intervals count each time. Two rows an interval and span, however long it is."""
    span = [*keys, "_span"]
    ends = F.array(F.struct(F.col("start0").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end0").alias("at"), F.lit(-1).alias("d")))
    points = _cut(a.where("end0 > start0"), keys).select(*span, F.explode(ends).alias("e")).groupBy(*span, "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*span).orderBy("at")
    seg = points.select(*keys, F.col("at").alias("start0"), F.lead("at").over(w).alias("end0"), F.sum("d").over(w).alias("n"))
    return seg.where("n > 0")


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _sweep(a, b, keys, (F.col("_a") > 0) & (F.col("_b") > 0))


def subtract(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _sweep(a, b, keys, (F.col("_a") > 0) & (F.col("_b") == 0))


def union_all(masks: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    if not masks:
        raise ValueError("no masks to unite")
    out = masks[0].select(*keys, "start0", "end0")
    for m in masks[1:]:
        out = out.union(m.select(*keys, "start0", "end0"))
    return merge(out, keys)


def complement(a: DataFrame, lengths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The gaps of a within (keys, length); sequences without an interval are one gap."""
    whole = lengths.where("length > 0").select(*keys, F.lit(0).cast("long").alias("start0"), F.col("length").cast("long").alias("end0"))
    return subtract(whole, a, keys)


def binned_join(points: DataFrame, intervals: DataFrame, on: Column, keys: list[str] = KEYS, width: int = 1024, start: str = "p_start0", end: str = "p_end0") -> DataFrame:
    """Pairs of ranges (keys, p_start0, p_end0) and intervals that on holds of, by an equi join on
    bins both touch; each pair comes from the first shared bin only, so nothing is deduplicated."""
    bins = lambda s, e: F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width))
    p = points.withColumn("_bin", F.explode(bins(F.col(start), F.col(end))))
    i = intervals.where("end0 > start0").withColumn("_bin", F.explode(bins(F.col("start0"), F.col("end0"))))
    first = F.col("_bin") == F.floor(F.greatest(F.col(start), F.col("start0")) / width)
    return p.join(i, [*keys, "_bin"]).where(first & on).drop("_bin")


def contains(position0: Column) -> Column:
    return (F.col("start0") <= position0) & (position0 < F.col("end0"))


def overlaps_range(start0: Column, stop0: Column) -> Column:
    """The asymmetric test of the original: the range starts in the interval, or the interval ends inside the range."""
    return ((F.col("start0") <= start0) & (start0 < F.col("end0"))) | ((start0 < F.col("end0")) & (F.col("end0") < stop0))


def overlaps(start0: Column, stop0: Column) -> Column:
    """The symmetric test."""
    return (F.col("start0") < stop0) & (start0 < F.col("end0"))


def positions(a: DataFrame, base: int = 0) -> DataFrame:
    return a.where("end0 > start0").withColumn("position", F.explode(F.sequence(F.col("start0") + base, F.col("end0") - 1 + base))).drop("start0", "end0")


def unknown_features(a: DataFrame) -> DataFrame:
    """One unknown call a masked position."""
    p = positions(a, 1).withColumn("position", F.col("position").cast("int"))
    return p.withColumns({"deletion": F.lit(1), "insertion": F.lit("?"), "var_type": F.lit("UNKNOWN_MISSING")})


def from_sequences(seqs: DataFrame) -> DataFrame:
    """Runs of N, n and - in (sequence, bases)."""
    runs = F.regexp_extract_all("bases", F.lit("([Nn-]+|[^Nn-]+)"), F.lit(1))
    r = seqs.select("sequence", F.posexplode(runs).alias("i", "run"))
    w = Window.partitionBy("sequence").orderBy("i")
    r = r.withColumn("end0", F.sum(F.length("run").cast("long")).over(w)).withColumn("start0", F.col("end0") - F.length("run"))
    return r.where(F.col("run").rlike("^[Nn-]")).select("sequence", "start0", "end0")


def from_variants(variants: DataFrame) -> DataFrame:
    """The merged spans of REF of (chrom, pos, ref)."""
    start = F.col("pos").cast("long") - 1
    return merge(variants.select(F.col("chrom").alias("sequence"), start.alias("start0"), (start + F.length("ref")).alias("end0")))


#: Bases of a slice: what an edit may cost to put in.
SLICE = 2048


def slices(seqs: DataFrame, bases: str = "bases") -> DataFrame:
    """seqs with their bases cut, a row a slice: (slice, bases), slices from 0; a null has one null row."""
    cut = F.when(F.col(bases) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(F.col(bases), F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)))
    return seqs.select(*[c for c in seqs.columns if c != bases], F.posexplode_outer(cut).alias("slice", "bases"))


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bases) from slices; null where there are none."""
    parts = F.sort_array(F.collect_list(F.struct("slice", "bases")))
    return rows.groupBy(*keys).agg(F.when(F.count("bases") > 0, F.array_join(F.transform(parts, lambda x: x["bases"]), "")).alias("bases"))


def mask_genome(seqs: DataFrame, masks: DataFrame, char: str | None = "?") -> DataFrame:
    """(sequence, bases) with masked positions replaced by char, or left out if char is None. Slices are
    masked each by itself, with the parts of the intervals that lie in it; one without bases stays so."""
    m = merge(masks).where("end0 > start0").withColumn("slice", F.explode(F.sequence((F.greatest("start0", F.lit(0)) / SLICE).cast("int"), ((F.col("end0") - 1) / SLICE).cast("int"))))
    first = F.col("slice").cast("long") * SLICE
    part = F.struct(F.greatest(F.col("start0") - first, F.lit(0)).cast("int").alias("lo"), F.least(F.col("end0") - first, F.lit(SLICE)).cast("int").alias("hi"))
    m = m.groupBy("sequence", "slice").agg(F.sort_array(F.collect_list(part)).alias("_m"))
    t = slices(seqs.select("sequence", "bases")).join(m, ["sequence", "slice"], "left")
    fill = lambda n: F.repeat(F.lit(char), n) if char else F.lit("")
    size = F.length("bases")

    def step(acc: Column, x: Column) -> Column:
        lo, hi = F.least(x["lo"], size), F.least(x["hi"], size)
        return F.struct(F.concat(acc["s"], F.substring("bases", acc["at"] + 1, lo - acc["at"]), fill(hi - lo)).alias("s"), hi.alias("at"))

    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    done = F.aggregate("_m", zero, step, lambda a: F.concat(a["s"], F.substring("bases", a["at"] + 1, size)))
    return joined(t.select("sequence", "slice", F.when(F.col("_m").isNull(), F.col("bases")).otherwise(done).alias("bases")), ["sequence"])


def length(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.col("end0") - F.col("start0")), F.lit(0)).cast("long").alias("length"))


def sequence_names(a: DataFrame) -> DataFrame:
    """(sequence) that the mask has an interval on."""
    return a.where("end0 > start0").select("sequence").distinct()
