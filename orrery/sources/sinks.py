"""Dated snapshot tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.rrg import wide
from orrery.sources import catalogue


def write_snapshot(frame: DataFrame, path: str, as_of: str, columns: list[str] | None = None, *partitions: str) -> None:
    """Publish an operator's table under its as-of date (and further partitions). A rerun replaces its own date only."""
    picked = frame.select(*[c for c in columns if c in frame.columns]) if columns else frame
    catalogue.publish_snapshot(picked, path, as_of, *partitions)


def write_stock_scores(scores: DataFrame, path: str, as_of: str) -> None:
    """Stock scores, split by capitalisation bucket; reading the folder gives all buckets as one table."""
    write_snapshot(scores, path, as_of, None, "cap_bucket")


def write_history(history: DataFrame, path: str, industry_names: list[str]) -> None:
    """The long history by year, and date by industry tables of three of its columns."""
    history.withColumn("year", F.year("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{path}/long")
    for value in ("sctr", "rs_ratio", "rs_momentum"):
        wide(history, value, industry_names).write.mode("overwrite").parquet(f"{path}/{value}")


def write_universe_jdbc(universe: DataFrame, url: str, table: str, **options: str) -> None:
    """The universe as a database table, with columns that can be compared (some dialects make large objects of strings)."""
    kinds = "ticker VARCHAR(64), group_name VARCHAR(64)"
    universe.write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=kinds, **options).save()


def all_buckets(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Stock scores of all buckets of the last date up to ``as_of``: the union of what was written bucket by bucket."""
    return catalogue.snapshot(spark, path, as_of)


#: The columns of bar files without capitalisations.
BAR_COLUMNS = ("Date", "Open", "High", "Low", "Close", "Volume")
#: Characters that Spark escapes in the names of partition folders.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
#: Folders that ``shared_path`` has given out, with the settings of their file system.
_SCRATCH: list[tuple] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both can write: under spark.checkpoint.dir. A local session (tests) may do
    without that setting and gets a temporary folder; a cluster may not. Results are lazy and read from it at any later time,
    so it is deleted when the driver's Python ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.append((place, spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def _remove_scratch() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, or the store out of reach
        for place, conf in _SCRATCH:
            place.getFileSystem(conf).delete(place, True)



def _write_named(rows: DataFrame, key: str, order: list[str], name: Callable[[str], str]) -> str:
    """CSV files named after a key, one each. Spark writes a folder per key; the driver then moves one file per folder."""
    spark = rows.sparkSession
    path = shared_path(spark, "files")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, key).sortWithinPartitions(key, *order).drop(*(c for c in order if c.startswith("_"))).write.partitionBy(key).csv(f"{path}-parts", header=True)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(path))
    for folder in fs.listStatus(hadoop(f"{path}-parts")):
        label = folder.getPath().getName()
        if folder.isDirectory() and label.startswith(f"{key}="):
            for file in fs.listStatus(folder.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), hadoop(f"{path}/{name(unquote(label.partition('=')[2]))}"))
    fs.delete(hadoop(f"{path}-parts"), True)
    return path


def _symbol_files(folder: str, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows, sorted by _symbol, as one CSV a symbol in a folder that the task sees; gives the number of its rows.

    A file gets its name when it is whole, and the same name if the task runs again.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.csv"
        started = f".{name}.{task.taskAttemptId()}"
        header, options = f"{','.join(columns)}\n".encode(), pacsv.WriteOptions(include_header=False)
        rows, own, place, out = 0, None, "", None

        def finish() -> None:
            if out is not None:
                out.close()
                os.replace(f"{place}/{started}", f"{place}/{name}")

        for batch in batches:
            codes = batch.column("_symbol").dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            values = batch.select(columns)
            for start, end in pairwise(starts):
                symbol = batch.column("_symbol")[start].as_py()
                if out is None or symbol != own:
                    finish()
                    own, place = symbol, f"{folder}/_symbol={'__HIVE_DEFAULT_PARTITION__' if symbol is None else _ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', symbol)}"
                    os.makedirs(place, exist_ok=True)
                    out = pa.OSFile(f"{place}/{started}", "wb")
                    out.write(header)
                pacsv.write_csv(values.slice(start, end - start), out, options)
            rows += batch.num_rows
        finish()
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    return write


def write_bar_files(bars: DataFrame, place: str | None = None) -> str:
    """One CSV per symbol, in a folder _symbol=NAME, in order of date (and of ``place`` in a date); the folder of all.

    Tasks put their files in place themselves, so the driver does nothing for a single file. Into a folder that driver and executors
    share as a disk they write with Arrow: Hadoop's local file system starts a chmod process for each folder, file and checksum that
    it makes, which is most of the time of small files. Elsewhere Spark's writer makes the same files.
    """
    spark = bars.sparkSession
    cap = [F.col("market_cap").alias("marketCap")] if "market_cap" in bars.columns else []
    # an empty name has the folder of none
    rows = bars.select(F.nullif(F.col("symbol").cast("string"), F.lit("")).alias("_symbol"), *(F.col(c.lower()).alias(c) for c in BAR_COLUMNS), *cap, (F.col(place) if place else F.lit(0)).alias("_place"))
    path = shared_path(spark, "files")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = rows.repartition(n, "_symbol").sortWithinPartitions("_symbol", "Date", "_place").drop("_place")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(folder)
        files.mapInArrow(_symbol_files(folder.toUri().getPath(), files.columns[1:]), "rows long").agg(F.sum("rows")).first()
    else:
        files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("_symbol").csv(path, header=True)
    return path


def write_batch_files(bars: DataFrame, day: Column) -> str:
    """One CSV of all symbols per value of ``day``, as batches come; the folder."""
    rows = bars.select(day.cast("string").alias("_day"), F.col("symbol").alias("Symbol"), *(F.col(c.lower()).alias(c) for c in ("Volume", "Close", "Low", "High", "Open")), F.col("date").alias("Date"))
    return _write_named(rows, "_day", ["Symbol", "Date"], lambda d: f"prices_1d_{d}.csv")


def round_trip(frame: DataFrame, as_of: str) -> DataFrame:
    """``frame`` after a write under its date, and a read of the last snapshot up to it."""
    path = shared_path(frame.sparkSession, "snapshot")
    write_snapshot(frame, path, as_of)
    return catalogue.snapshot(frame.sparkSession, path, as_of).select(*frame.columns)
