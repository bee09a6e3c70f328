"""Sets of sample ids as words of 64 bits: a row holds the ids of one word, so it is small for a rare feature
and bounded however many samples a feature has; words are built and united by hash aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits whose place has bit k, for k from 0 on.
_PLACES = (0xAAAAAAAAAAAAAAAA, 0xCCCCCCCCCCCCCCCC, 0xF0F0F0F0F0F0F0F0, 0xFF00FF00FF00FF00, 0xFFFF0000FFFF0000, 0xFFFFFFFF00000000)


def to_bitmaps(pairs: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, word, bits) from (by, sample_id); a repeated id counts once. Rows meet before the shuffle."""
    n = F.col("sample_id").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)).cast("int"))
    return pairs.select(*by, F.shiftright(n, 6).alias("word"), bit.alias("bits")).groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def union_bitmaps(*maps: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The sets of all tables, united by feature and word."""
    both = maps[0]
    for m in maps[1:]:
        both = both.unionByName(m)
    return both.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def _least(bits: Column) -> Column:
    """The place of the lowest bit: all above it are set, and the others counted."""
    for n in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseOR(F.shiftleft(bits, n))
    return 64 - F.bit_count(bits)


def _most(bits: Column) -> Column:
    for n in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
    return F.bit_count(bits) - 1


def _sum(bits: Column) -> Column:
    """The sum of the places of the bits that are set."""
    out = F.lit(0)
    for k, mask in enumerate(_PLACES):
        out = out + F.bit_count(bits.bitwiseAND(F.lit(mask - 2**64))) * (1 << k)
    return out


def ids(word: Column, bits: Column) -> Column:
    """The sample ids of a word in order."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.transform(places, lambda i: word * 64 + i)


def from_bitmaps(maps: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, sample_id) from bitmaps."""
    return maps.select(*by, F.explode(ids(F.col("word"), F.col("bits"))).alias("sample_id"))


def sizes(maps: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, n) of united bitmaps: bits are counted, no id is listed."""
    return maps.groupBy(*by).agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))


def described(maps: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, n, low, high, ids): size, least, largest and sum of the ids, from the bits of each word."""
    one = maps.select(*by, "word", "bits", F.bit_count("bits").cast("long").alias("n"))
    at = F.col("word") * 64
    return one.groupBy(*by).agg(F.sum("n").alias("n"), F.min(at + _least(F.col("bits"))).alias("low"), F.max(at + _most(F.col("bits"))).alias("high"), F.sum(at * F.col("n") + _sum(F.col("bits"))).alias("ids"))
