"""Published versions of a table: readers see what a writer has finished, and nothing else.

A version is written into a folder of its own. It counts from the moment at which an empty file with its label stands in the
table's ``_published`` folder; a write that fails leaves a folder that no label names. Labels sort in the order of versions, so
the newest one is found by listing one folder, without a look at the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    """The path as Hadoop's, and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, label: str) -> None:
    """Make a version visible; an error if its label is there already."""
    place, fs = _place(spark, f"{path}/_published/{label}")
    fs.create(place, False).close()


def published(spark: SparkSession, path: str) -> list[str]:
    """Labels in order; none where nothing was published."""
    place, fs = _place(spark, f"{path}/_published")
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def publish_snapshot(frame: DataFrame, path: str, as_of: str, *partitions: str) -> None:
    """Write a table under its as-of date and publish it. A rerun of a date replaces it; what it replaces goes afterwards."""
    spark, run = frame.sparkSession, uuid.uuid4().hex
    frame.write.partitionBy(*partitions).parquet(f"{path}/as_of={as_of}/run={run}")
    old = [label for label in published(spark, path) if label.startswith(f"{as_of}.")]
    place = max((int(label.split(".")[1]) + 1 for label in old), default=0)
    publish(spark, path, f"{as_of}.{place:06d}.{run}")
    for label in old:
        remove(spark, f"{path}/_published/{label}")
        remove(spark, f"{path}/as_of={as_of}/run={label.split('.')[2]}")


def snapshot_dates(spark: SparkSession, path: str) -> dict[str, str]:
    """The run that counts for each published date, by date."""
    return {date: run for date, _, run in (label.split(".") for label in published(spark, path))}


def snapshot(spark: SparkSession, path: str, upto: str | None = None, exact: bool = False, before: str | None = None) -> DataFrame | None:
    """The snapshot of the last published date: of all, up to a date, exactly at one, or strictly before one; None without such."""
    runs = snapshot_dates(spark, path)
    dates = [d for d in runs if (upto is None or (d == upto if exact else d <= upto)) and (before is None or d < before)]
    if not dates:
        return None
    return spark.read.parquet(f"{path}/as_of={max(dates)}/run={runs[max(dates)]}").withColumn("as_of", F.to_date(F.lit(max(dates))))
