"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so, each chunk gets a 64-bit identifier that is verified by
the SHA-256 of the chunks' contents, and documents are equal when their ordered identifier lists
are. Texts are read and cut once; neither they nor their chunks ever move, only digests do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, ascii_lower

def _marks(*residues: int) -> str:
    """A class of the Latin-1 characters whose code points leave these residues modulo 8; classes
    beyond Latin-1 are no bit sets and take 50 times as long."""
    return "[" + "".join(f"\\x{c:02X}" for c in range(0x20, 0x100) if c % 8 in residues) + "]"


#: A chunk ends behind four bytes of these classes in a row (one place in 250 to 600 in the four
#: languages here), but not before 256 bytes and after 8,192 in any case. Characters of several bytes have
#: their chance in their last bytes, the others being much the same in a script: two such in a row, of a
#: sixteenth of the values each, are an end too.
#: Whether a place is a boundary depends on its own bytes, so texts that share a long passage soon cut it
#: alike, wherever it stands, in any script.
LEAST, MOST = 256, 8192
_ENDS = f"{_marks(0)}{_marks(1)}{_marks(3)}{_marks(0, 2, 4, 5)}"
_WIDE = r"[\x85\x95\xA5\xB5][\xC2-\xF4][\x80-\xBF]{0,2}[\x82\x92\xA2\xB2]"
CHUNK, WIDE_CHUNK = (rf"(?s).{{{LEAST - 4},{MOST - 5}}}?(?:{ends}|\z)|.{{1,{MOST}}}" for ends in (_ENDS, f"{_ENDS}|{_WIDE}"))


def chunks(text: Column) -> Column:
    """The text's UTF-8 bytes, as characters of that number, in pieces. These may end within a character of
    the text; only equal texts have equal pieces. ASCII texts are their bytes already."""
    narrow = F.octet_length(text) == F.char_length(text)
    wide = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.when(narrow, F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))).otherwise(F.regexp_extract_all(wide, F.lit(WIDE_CHUNK), F.lit(0)))


def recipe(text: Column) -> Column:
    """(fp, digest) of each chunk in order."""
    return F.transform(chunks(text), lambda c: F.struct(F.xxhash64(c).alias("fp"), F.unhex(F.sha2(c, 256)).alias("digest")))


def verified_collisions(lists: DataFrame) -> DataFrame:
    """Identifiers (fp) that two different chunks share; all others stand for one content.

    The aggregation keeps the least and the greatest digest of each identifier: they differ if and
    only if the identifier is ambiguous. Copies of a chunk meet before the shuffle.
    """
    parts = lists.select(F.explode("parts").alias("part")).select("part.fp", "part.digest")
    return parts.groupBy("fp").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("fp")


def duplicates(docs: DataFrame, scratch: Scratch | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and the
    empty text has an empty list. The row with the largest doc_id stays; a null doc_id stays only
    where the whole group has none. Rows that repeat both doc_id and text stay together. An empty
    table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.col(ident).alias("doc_id"), norm.alias("norm"))
    lists = scratch.cut(base.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), recipe(F.col("norm")).alias("parts")), "recipes")
    collided = scratch.cut(verified_collisions(lists), "collided")
    lists = lists.select("doc_id", "text_sha256", F.col("parts.fp").alias("recipe"))
    # A list with an ambiguous identifier says nothing by itself: there the whole text's digest is
    # compared beside it. The table is as small as 64-bit collisions are rare.
    unsure = lists.select("recipe", F.explode("recipe").alias("fp")).join(collided, "fp", "left_semi").select("recipe").distinct()
    unsure = scratch.cut(unsure.withColumn("unsure", F.lit(True)), "unsure")
    lists = lists.join(unsure, "recipe", "left").withColumn("tie", F.when(F.col("unsure"), F.col("text_sha256")).otherwise(F.lit("")))
    groups = lists.groupBy("recipe", "tie").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).where("n > 1")
    groups = scratch.cut(groups, "groups")
    same = lists.join(groups, ["recipe", "tie"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return same.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
