"""Token counts through a digest cache.

``count_tokens`` joins the digest of each text and the digest of the tokenizer (its file's bytes, and the rule for
special strings) to stored counts. Texts whose digest is not stored are encoded once per distinct digest, and their
counts are appended to the cache; a later run with the same cache encodes nothing that it holds.

Defined results: null text counts as empty text (0 bytes, 0 tokens); copies share one cache row; an empty table gives an
empty result; further columns of ``docs`` do not matter, whatever their names. Normalisation before hashing is
"null becomes empty" and nothing else, since anything more would change counts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import shared_dir, table
from orrery.llm.tokens import encoder

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Texts encoded at a time by one worker, in bytes of text (at least one text).
CHUNK_BYTES = 4_000_000


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|special strings as the library's default").hexdigest()


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK_BYTES of text each, so that memory follows neither batch nor partition size."""
    at, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if i > at and size + n > CHUNK_BYTES:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)
    # workers live on for later tasks: what this batch needed goes back to the system
    pa.default_memory_pool().release_unused()


def _encode_counts(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path, kind)
        for whole in batches:
            for batch in chunks(whole, 1):
                _, offsets = memo.batch(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, kind: str, cache_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; the counts of texts not met before are appended to the cache.

    Two shuffles of (digest) rows and one of the texts that were missing: the first copy of each digest is chosen by an
    aggregation with map-side combining, so a group of copies of any size sends one text per map task.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    cached = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = rows.join(cached.select("digest"), "digest", "left_anti").dropDuplicates(["digest"]).select("digest", "text")
    counted = missing.mapInArrow(_encode_counts(tokenizer_path, kind), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.drop("text").join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where the folder does not exist yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for byte_bpe_50k.json over all documents, from a cache that starts empty."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
