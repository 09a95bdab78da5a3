"""Incremental ingest of bar batches.

A bar table is a folder of versions: ``bars`` holds the rows that each batch added, ``ends`` the last date of every symbol
after it. A batch reads the small ``ends`` of the last published version and nothing of ``bars``; it writes its rows and new ends
under the next version and publishes both at once (``catalogue``). A batch that fails on the way leaves an unpublished version,
which the next try overwrites; a batch that comes again is known by the label of its version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.sources import catalogue
from orrery.sources.readers import new_rows
from orrery.sources.sinks import shared_path

ENDS = "symbol string, last date"


def versions(spark: SparkSession, table: str) -> list[tuple[int, str, int]]:
    """(version, stream, batch) of the published versions."""
    labels = (label.split(".") for label in catalogue.published(spark, table))
    return [(int(v), stream, int(batch)) for v, stream, batch in labels]


def _publish(bars: DataFrame, ends: DataFrame | None, table: str, version: int, stream: str, batch: int) -> None:
    spark = bars.sparkSession
    bars.write.mode("overwrite").parquet(f"{table}/bars/version={version}")
    own = spark.read.schema(bars.schema).parquet(f"{table}/bars/version={version}").select("symbol", F.col("date").alias("last"))
    rows = own if ends is None else own.unionByName(ends)
    rows.groupBy("symbol").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{table}/ends/version={version}")
    catalogue.publish(spark, table, f"{version:09d}.{stream}.{batch}")


def create(history: DataFrame, table: str) -> None:
    """A bar table from a history (symbol, date, ...)."""
    _publish(history, None, table, 0, "history", 0)


def last_dates(spark: SparkSession, table: str) -> DataFrame:
    """(symbol, last) after the last published version."""
    return spark.read.schema(ENDS).parquet(f"{table}/ends/version={versions(spark, table)[-1][0]}")


def stored_bars(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all published versions."""
    return spark.read.parquet(*(f"{table}/bars/version={v}" for v, _, _ in versions(spark, table)))


def append_new(batch: DataFrame, table: str, stream: str, number: int) -> None:
    """Append the rows of a batch after each symbol's last date, once, however often the batch comes."""
    spark = batch.sparkSession
    known = versions(spark, table)
    if (stream, number) in {k[1:] for k in known}:
        return
    last = known[-1][0]
    ends = last_dates(spark, table)
    _publish(new_rows(ends, batch), ends, table, last + 1, stream, number)
    if last > 0:  # readers of the version before may still be at work
        catalogue.remove(spark, f"{table}/ends/version={last - 1}")


def ingest(source: DataFrame, table: str, checkpoint: str, late: str = "10 days", stream: str = "bars") -> StreamingQuery:
    """Stream new bars (symbol, date, ...) into a bar table, each (symbol, date) once, rows later than ``late`` dropped.

    ``stream`` names the checkpoint: batches of one name have numbers of their own.
    """
    timed = source.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "date"]).drop("ts")
    return timed.writeStream.foreachBatch(lambda batch, n: append_new(batch, table, stream, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(history: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """The table after ``batches`` have been streamed onto ``history``, one after another, the stream stopped in between."""
    spark: SparkSession = history.sparkSession
    table, incoming, checkpoint = (shared_path(spark, n) for n in ("bars", "incoming", "ingest"))
    create(history, table)
    for batch in batches:
        batch.write.mode("append").parquet(incoming)
        ingest(spark.readStream.schema(batch.schema).parquet(incoming), table, checkpoint).awaitTermination()
    return stored_bars(spark, table)
