"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WHITESPACE = " \t\n\x0b\x0c\r"


#: Rows that go to a Python worker at a time. Rows hold whole texts, so Spark's default of 10,000 would let batches of tens
#: of MB grow on both sides of every task; a lower setting of the session's own stays.
ROWS_PER_BATCH = 1_000


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small in this session. Results are lazy, so the setting has to outlast the call."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary one; a cluster has no folder that all executors see, so
    that is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, label: str, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors lose nothing.

    The shuffle files of the plan that is written are of no further use, so Spark removes them when the write ends.
    """
    spark = df.sparkSession
    text_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_per_batch)}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in written:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stacked(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from ``taken`` (as Spark compares names)."""
    lower = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null text: empty array)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    """Number of words without building them: positions where a word starts."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (a one-element transform keeps Catalyst from repeating it)."""
    return F.transform(F.array(value), body)[0]


def arrow_words(texts: pa.Array, lower: bool = False) -> pa.ListArray:
    """Words of each text as an Arrow list array; null texts give empty lists."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.replace_substring_regex(texts, r"[\x09-\x0D ]+", " ")
    texts = pc.utf8_trim(texts, " ")
    lists = pc.split_pattern(texts, " ")
    return lists


#: Tables of a few narrow columns up to this many rows are broadcast (some tens of MB); longer ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written out and narrow, with a broadcast hint if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
