"""Shared plumbing: lineage cuts in the shared folder, global ranks, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.session import shared_root, ship

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column, blanks: str = "") -> Column:
    """Lower-case A-Z only, and turn `blanks` (beyond ASCII) into spaces. lower() agrees with that on
    pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, A_Z + blanks, a_z + " " * len(blanks)))


#: What a Python worker gets at once: texts are long, and a worker keeps what it once needed.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches of this session (smaller settings stay)."""
    ship(spark)
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written to the shared checkpoint folder. A lost executor costs a re-read, not a
    recomputation, and whatever is read back is a plain scan, so adaptive execution can split
    the skewed side of a later join. Results read them lazily, so tables that are not freed live until
    close(), the end of a `with Scratch(spark)` block, or the application's end."""

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/triloom-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete all tables: for callers that have written what they wanted of the result."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._triloom_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = getattr(df, "_triloom_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def ranked(scratch: Scratch, df: DataFrame, order: list[Column], rank: str = "rank") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order: one range shuffle, then a count for each
    partition. Only those counts (as many as partitions) come to the driver. End the order with
    something that tells ties apart, or equal rows all land in one partition.
    """
    spark = scratch.spark
    parts = shuffle_partitions(spark)
    part, row, start = unused([*df.columns, rank], "_pid", "_row", "_start")
    pid = F.spark_partition_id()
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({part: pid, row: F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)})
    )
    placed = scratch.cut(placed, "ranked")
    counts = sorted((r[part], r["n"]) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts or [(-1, 0)], f"`{part}` int, `{start}` long")
    out = placed.join(F.broadcast(offsets), part).withColumn(rank, F.col(start) + F.col(row))
    return out.drop(part, row, start), total


def row_keys(scratch: Scratch, docs: DataFrame, nulls_first: bool = False) -> tuple[DataFrame, str] | None:
    """docs with a gapless key for each row in the order of doc_id, and the key's name, if a doc_id is
    null or repeated; None if doc_id names the rows already. Only then are texts moved and written."""
    same = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if same.isEmpty():
        return None
    key, tie = unused(docs.columns, "_key", "_tie")
    own = F.col("doc_id").asc_nulls_first() if nulls_first else F.col("doc_id").asc_nulls_last()
    rows = docs.withColumn(tie, F.monotonically_increasing_id())  # equal rows too are dealt to many tasks
    return ranked(scratch, rows, [own, F.xxhash64("text"), F.col(tie)], key)[0].drop(tie), key


#: Hashed places of a bitmap that is broadcast: 2 MB, whatever the number of ids.
PLACES = 1 << 24


def likely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ids (key), for a join to decide: so that long rows that are not
    asked for are not shuffled. Ids set bits of a bitmap of PLACES; where they are so many that
    most bits are set, more rows pass than need to, and none is ever lost."""
    place = F.pmod(F.xxhash64(key), F.lit(PLACES)) + 1  # bitmap positions count from 1
    maps = ids.select(F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).alias("_bit"))
    maps = maps.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    part, bits, at = unused(rows.columns, "_part", "_bits", "_at")
    found = rows.withColumns({part: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(F.broadcast(maps.select(F.col("_part").alias(part), F.col("_bits").alias(bits))), part)
    byte = F.conv(F.hex(F.substring(bits, (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.col(at) % 8) == 1).drop(part, bits, at)


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps: each needs one aggregation with map-side combine
    and one join, keeps the edge count from growing and converges in about log rounds. Both join
    inputs are written tables, so that a hub's neighbours are split over tasks. Edges with a null
    end and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = scratch.cut(e.where("_a is not null and _b is not null and u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        sym = e.union(e.select("v", "u"))
        low = scratch.cut(sym.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), "large-min")
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large, "large")
        low2 = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.cut(small.union(low2.select("u", "m")).distinct(), "edges")
        seen = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        scratch.free(e, low, large, low2)
        e = new
        if seen == mark:
            break
        mark = seen
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
