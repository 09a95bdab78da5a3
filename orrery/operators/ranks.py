"""Ranks over all rows of a table, without a window over all of them.

Rows are range-partitioned in the order of the rank into blocks, stamped with their block's number and written; a block is
ranked by itself, and what the blocks ahead hold is added. Blocks are described by one row each (count, least and greatest
value with their ties), so the only window over everything is over these. Ties may cross borders of blocks: a value that many
rows share is spread over several blocks by the entity's key, and its share of each is summed up.

Nulls have no rank, keys are compared with nulls equal, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import np_round
from orrery.sources.sinks import shared_path


def _blocks(frame: DataFrame, order: Sequence[Column], blocks: int | None) -> DataFrame:
    """``frame`` with ``_block``, written: sampled borders may differ when a plan runs again, what is written stays."""
    spark = frame.sparkSession
    count = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "blocks")
    stamped = frame.repartitionByRange(count, *order).withColumn("_block", F.spark_partition_id())
    stamped.write.parquet(path)
    return spark.read.schema(stamped.schema).parquet(path)


def _attach(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys``, nulls equal."""
    other = found.select(*(F.col(k).alias(f"_on_{k}") for k in keys), *(c for c in found.columns if c not in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys))
    return rows.join(other, same, "left").drop(*(f"_on_{k}" for k in keys))


def _over_blocks(keys: Sequence[str]):
    """All blocks of a key in order, one row each."""
    return Window.partitionBy(*keys).orderBy("_block")


def with_position(frame: DataFrame, name: str, *order: Column, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``frame`` with the row number in a given order (name the entity's key last, so that ties are settled)."""
    rows = _blocks(frame, [*map(F.col, keys), *order], blocks)
    ahead = F.sum("_size").over(_over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select(*keys, "_block", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    return _attach(own, sizes, [*keys, "_block"]).withColumn(name, (F.col("_own") + F.col("_ahead")).cast("int")).drop("_own", "_ahead", "_block")


def with_standing(frame: DataFrame, x: str, *entity: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``frame`` with ``_below`` (rows of a smaller value), ``_ties`` (rows of this value, its own included) and ``_known`` (rows of
    any value). ``entity`` names columns by which rows of one value may be spread over blocks."""
    rows = _blocks(frame.withColumn("_null", F.col(x).isNull()), [*map(F.col, keys), F.col("_null"), F.col(x), *map(F.col, entity)], blocks)
    k = [*keys, "_null"]
    counted = rows.groupBy(*k, "_block", x).agg(F.count(F.lit(1)).alias("_n"))
    ends = counted.groupBy(*k, "_block").agg(F.sum("_n").alias("_size"), F.min(x).alias("_low"), F.max(x).alias("_high"), F.min_by("_n", x).alias("_low_n"), F.max_by("_n", x).alias("_high_n"))
    ahead = F.sum("_size").over(_over_blocks(k).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("*", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_size").over(Window.partitionBy(*k)).alias("_known"))
    # values at borders: where they begin, and how many rows all blocks have of them
    low = ends.select(*k, F.col("_low").alias("_value"), F.col("_low_n").alias("_n"), F.col("_ahead").alias("_from"))
    high = ends.where(F.col("_high") > F.col("_low")).select(*k, F.col("_high").alias("_value"), F.col("_high_n").alias("_n"), (F.col("_ahead") + F.col("_size") - F.col("_high_n")).alias("_from"))
    borders = low.unionByName(high).groupBy(*k, "_value").agg(F.sum("_n").alias("_n"), F.min("_from").alias("_from"))
    for side in ("_low", "_high"):
        at = borders.select(*k, F.col("_value").alias(side), F.col("_n").alias(f"{side}_ties"), F.col("_from").alias(f"{side}_from"))
        ends = _attach(ends, at, [*k, side])
    w = Window.partitionBy(*k, "_block").orderBy(x)
    own = rows.select("*", (F.rank().over(w) - 1).alias("_own"), F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)).alias("_own_ties"))
    placed = _attach(own, ends.select(*k, "_block", "_low", "_high", "_ahead", "_known", *(f"{s}_{c}" for s in ("_low", "_high") for c in ("ties", "from"))), [*k, "_block"])
    value = F.col(x)

    def at_border(what: str, inside: Column) -> Column:
        return F.when(value == F.col("_low"), F.col(f"_low_{what}")).when(value == F.col("_high"), F.col(f"_high_{what}")).otherwise(inside)

    known = {"_below": at_border("from", F.col("_ahead") + F.col("_own")), "_ties": at_border("ties", F.col("_own_ties")), "_known": F.col("_known")}
    return placed.select(*frame.columns, *(F.when(value.isNotNull(), c).alias(n) for n, c in known.items()))


def _share() -> Column:
    """Mean rank of the ties over the number of rows with a value."""
    return (F.col("_below") + 1 + (F.col("_ties") - 1) / 2) / F.col("_known")


def _with(frame: DataFrame, name: str, value: Column, x: str, entity: Sequence[str], keys: Sequence[str], blocks: int | None) -> DataFrame:
    return with_standing(frame, x, *entity, keys=keys, blocks=blocks).withColumn(name, value).drop("_below", "_ties", "_known")


def with_share(frame: DataFrame, name: str, x: str, *entity: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Average rank over the count of values, from above 0 to 1."""
    return _with(frame, name, _share(), x, entity, keys, blocks)


def with_sctr(frame: DataFrame, name: str, x: str, *entity: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Percentile rank from 0 to 99.9."""
    return _with(frame, name, np_round(_share() * 99.9, 1), x, entity, keys, blocks)


def with_percentile(frame: DataFrame, name: str, x: str, *entity: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Percentile rank as a whole number from 1 to 99."""
    return _with(frame, name, F.rint(_share() * 98 + 1).cast("int"), x, entity, keys, blocks)


def with_min_rank(frame: DataFrame, name: str, x: str, *entity: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Rank from the largest value, ties take the least rank."""
    return _with(frame, name, (F.col("_known") - F.col("_below") - F.col("_ties") + 1).cast("int"), x, entity, keys, blocks)
