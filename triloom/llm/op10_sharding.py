"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws an exponential variate of
its weight from a hash of the key and the child's name, and the least draw wins, so a child gets
keys in proportion to its weight. A change of weight below one child lowers or raises that child's
draws only: keys move into or out of the subtree that changed and nowhere else. A subtree that is
added beside the others therefore takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, ranked, unused


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def grid(shards: int, racks: int = 4, per_rack: int = 5) -> list[Shard]:
    """Shards 0.. in order, per_rack to a rack and racks to a region, all of weight 1."""
    return [Shard(f"g{i // (racks * per_rack)}", f"k{i // per_rack}", i) for i in range(shards)]


def add_shard(topology: list[Shard], weight: float = 1.0, region: str | None = None, rack: str | None = None) -> list[Shard]:
    """One more shard. By itself it is a region of its own, and rows move only into it. With a region
    (and a rack in it) it joins that subtree, whose weights grow: rows of other regions move only into
    the region, rows of its other racks only into the rack, and rows of the rack only to the new shard."""
    number = max(s.number for s in topology) + 1
    return [*topology, Shard(region or f"added{number}", rack or f"added{number}", number, weight)]


def _draw(key: Column, level: str, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{name}")), 12)
    return -F.log((bits.cast("double") + 0.5) / float(2**52)) / F.lit(float(weight))


def _pick(key: Column, level: str, children: dict[str, float]) -> Column:
    """The name of the child with the least draw; the lesser name on a tie."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*[F.struct(_draw(key, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(children.items())]))["n"]


def _choose(on: Column, cases: dict[str, Column]) -> Column:
    out = None
    for name, value in cases.items():
        out = F.when(on == name, value) if out is None else out.when(on == name, value)
    return out


def assign(df: DataFrame, key: str, topology: list[Shard], out: str = "shard") -> DataFrame:
    """Adds the shard of each row, from the key and the topology alone.

    The topology is a short list in driver code. A null key counts as one more key. Shards of
    weight 0 or less take nothing. Rows that repeat a key share its shard. All columns stay; one
    called `out` gives way to the shard.
    """
    live = [s for s in topology if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    regions: dict[str, dict[str, dict[str, float]]] = {}
    for s in live:
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[str(s.number)] = s.weight
    total = lambda racks: {n: sum(x.values()) for n, x in racks.items()}
    at_region, at_rack = unused([*df.columns, out], "_region", "_rack")
    df = df.withColumn(at_region, _pick(k, "region", {n: sum(total(r).values()) for n, r in regions.items()}))
    df = df.withColumn(at_rack, _choose(F.col(at_region), {n: _pick(k, f"rack/{n}", total(r)) for n, r in regions.items()}))
    racks = {(g, r): x for g, rs in regions.items() for r, x in rs.items()}
    leaf = _choose(F.col(at_region), {g: _choose(F.col(at_rack), {r: _pick(k, f"shard/{g}/{r}", x) for (h, r), x in racks.items() if h == g}) for g in regions})
    return df.withColumn(out, leaf.cast("int")).drop(at_region, at_rack)


def shard_documents(docs: DataFrame, topology: list[Shard]) -> DataFrame:
    """Where each document goes and its place there.

    Returns doc_id, size (UTF-8 bytes of the text and 16; a null text has none), text_crc32 (0 for a
    null or empty text), law ('key': the doc_id and the topology decide), shard, slot (gapless from
    0 in a shard, by doc_id) and grown_shard (with one more shard added). Rows that repeat a doc_id
    share its shard and get slots of their own. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(assign(rows, "doc_id", topology), "doc_id", add_shard(topology), "grown_shard")
    rows = scratch.cut(rows, "placed")
    firsts, base = [], 0
    for shard, n in sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()):
        firsts.append((shard, base))
        base += n
    tie = [F.col("shard"), F.col("doc_id"), F.xxhash64("doc_id", "size", "text_crc32")]
    placed, _ = ranked(scratch, rows, tie)
    starts = spark.createDataFrame(firsts or [(-1, 0)], "shard int, _first long")  # one row a shard of the topology
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") - F.col("_first")).alias("slot"), "grown_shard"
    )
