"""Incremental ingest: files that arrive in a folder are upserted batch by batch.

The index keeps rows unique by (feature, sample), so a batch that is replayed after a failure
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triloom.functions import ids
from triloom.index import SampleIndex
from triloom.schema import struct

ARRIVING_CALLS = struct("sample string, chrom string, pos int, ref string, alt string")


def stream_variants(spark: SparkSession, folder: str, index: SampleIndex, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads tab-separated variant rows that are dropped in a folder into the index.

    once: take what is there and stop; otherwise run on.
    """
    rows = spark.readStream.schema(ARRIVING_CALLS).option("sep", "\t").csv(folder)
    rows = rows.withColumn("type", ids.variant_type(F.col("ref"), F.col("alt")))

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.add_variants(batch, allow_existing=True)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_counts(calls: DataFrame, time_column: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Calls a window and variant type, of a stream with an event time; later rows than `late` are dropped by the watermark."""
    return calls.withWatermark(time_column, late).groupBy(F.window(time_column, window), "var_type").agg(F.count("*").alias("n"))
