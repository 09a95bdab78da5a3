"""Industry indexes and their weekly history in steps: a step reads its own bars and a small state, never older bars.

The state after a step, by name of its tables (freq is "d" or "w"):

- weights: (freq, industry_key, symbol, weight, members), fixed at the start
- closes: (freq, industry_key, symbol, close, place), the last close of each constituent and the number of its date
- index: (freq, industry_key, date, close, members, place), the last rows of each index
- means: (industry_key, date, close, fast, slow, signal, hist), exponential means of the same last days
- past: the last four rows of each industry's history

Steps end with a week, and an industry's first step holds at least two of its dates. The last rows are as many as windows need:
200 days and 15 months of the daily index, and of the weekly one enough for the rotation's chain of windows, as long as none of
them is flat (a flat window gives no value, and the chain would reach back farther).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.columns import scope
from orrery.operators.bars import as_of, close_series, weekly_dates
from orrery.operators.indicators import ppo_parts
from orrery.operators.rrg import history_rows, rotation
from orrery.operators.sctr import component_series
from orrery.operators.synthetic_index import BASE, changes, member_closes
from orrery.sources import catalogue

TABLES = ("weights", "closes", "index", "means", "past")
#: Rows of an index that a state holds, by frequency: 18 months of weekdays, and weeks.
TAIL = {"d": 400, "w": 120}
FREQS = ("d", "w")


def last_of(frame: DataFrame, keys: list[str], n) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return frame.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def no_state(spark: SparkSession, weights: DataFrame) -> dict[str, DataFrame]:
    """What a first step starts from."""
    empty = {
        "closes": "freq string, industry_key string, symbol string, close double, place int",
        "index": "freq string, industry_key string, date date, close double, members int, place int",
        "means": "industry_key string, date date, close double, fast double, slow double, signal double, hist double",
        "past": "industry_key string, date date, rs_ratio double, rs_momentum double",
    }
    return {"weights": weights} | {name: spark.createDataFrame([], kind) for name, kind in empty.items()}


def extended_index(state: dict[str, DataFrame], closes: DataFrame, fill, keep=lambda frame: frame) -> tuple[DataFrame, DataFrame]:
    """(new index rows, last closes after them). ``closes``: the new rows of ``member_closes``, with the close before each.

    Only a constituent's first new close looks at the state's closes; the others meet as sums by pairs of dates, which ``keep`` may write out.
    """
    k = scope(closes, "industry_key")
    weights = state["weights"].select(*k, "symbol", "weight", "members")
    own = closes.drop("cap").join(weights.select(*k, "symbol", F.col("weight").alias("cap")), [*k, "symbol"])
    changed = keep(changes(own))
    ends = state["index"].groupBy(*k).agg(F.max_by("close", "date").alias("level"), F.max("place").alias("last"))
    days = changed.select(*k, "date").distinct().join(ends, k, "left")
    order = Window.partitionBy(*k).orderBy("date")
    days = days.withColumn("place", F.row_number().over(order) + F.coalesce("last", F.lit(0)))
    placed = days.select(*k, "date", "place")
    later = changed.where("before is not null").join(placed.select(*k, F.col("date").alias("before"), F.col("place").alias("_from")), [*k, "before"])
    old = state["closes"].select(*k, "symbol", "close", "place")
    begun = own.where("before is null").join(old.select(*k, "symbol", F.col("close").alias("_old"), F.col("place").alias("_from")), [*k, "symbol"])
    begun = begun.withColumn("capped", F.col("cap") * (F.try_divide("close", "_old") - 1))
    linked = later.select(*k, "date", "_from", "capped").unionByName(begun.select(*k, "date", "_from", "capped")).join(placed, [*k, "date"])
    daily = linked.where(F.col("place") - F.col("_from") <= fill + 1).groupBy(*k, "date").agg(F.sum("capped").alias("r"))
    counts = weights.groupBy(*k).agg(F.first("members").cast("int").alias("members"))
    grown = F.product(1 + F.coalesce("r", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    index = days.join(daily, [*k, "date"], "left").join(counts, k).select(*k, "date", (F.coalesce("level", F.lit(BASE)) * grown).alias("close"), "members", "place")
    newest = own.groupBy(*k, "symbol").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date")).join(placed, [*k, "date"])
    rows = old.unionByName(newest.select(*k, "symbol", "close", "place"))
    return index, rows.groupBy(*k, "symbol").agg(F.max_by("close", "place").alias("close"), F.max("place").alias("place"))


def step(state: dict[str, DataFrame], bars: DataFrame, membership: DataFrame, benchmark: DataFrame, industries: DataFrame, keep) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(history rows of the weeks in ``bars``, state after them).

    ``benchmark``: weekly closes from as far back as the state's weeks. ``keep`` writes a table out and returns it.
    """
    fill = F.when(F.col("freq") == "d", 5).otherwise(2)
    new, closes = extended_index(state, keep(member_closes(close_series(bars, FREQS), membership)), fill, keep)
    new = keep(new)
    both = state["index"].unionByName(new)
    of = lambda frame, freq: frame.where(F.col("freq") == freq).drop("freq")
    begin = state["means"].groupBy("industry_key").agg(*(F.max_by(c, "date").alias(c) for c in ("fast", "slow", "signal")))
    means = keep(state["means"].unionByName(ppo_parts(of(new, "d"), "industry_key", begin).select(*state["means"].columns)))
    series = component_series(of(both, "d"), parts=means)
    turned = rotation(of(both, "w"), benchmark)
    dates = weekly_dates(of(new, "d").select("date"))
    history = keep(history_rows(series, turned, dates, industries, state["past"]))
    after = {
        "weights": state["weights"],
        "closes": closes,
        "index": last_of(both, ["freq", "industry_key"], F.when(F.col("freq") == "d", TAIL["d"]).otherwise(TAIL["w"])),
        "means": last_of(means, ["industry_key"], TAIL["d"]),
        "past": last_of(state["past"].unionByName(history.select(*state["past"].columns)), ["industry_key"], 4),
    }
    return history, after


def publish_step(history: DataFrame, state: dict[str, DataFrame], path: str, date: str) -> None:
    """Publish the tables of a step under its last date; the history last, so that a date with a history has its state."""
    for name in TABLES:
        catalogue.publish_snapshot(state[name], f"{path}/{name}", date)
    catalogue.publish_snapshot(history, f"{path}/history", date)


def stored_state(spark: SparkSession, path: str, before: str) -> dict[str, DataFrame]:
    """The state after the last published step before a date."""
    date = max(d for d in catalogue.snapshot_dates(spark, f"{path}/history") if d < before)
    return {name: catalogue.snapshot(spark, f"{path}/{name}", date, exact=True).drop("as_of") for name in TABLES}


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """The history of all published steps."""
    runs = catalogue.snapshot_dates(spark, f"{path}/history")
    return spark.read.parquet(*(f"{path}/history/as_of={d}/run={run}" for d, run in runs.items()))


def replay(bars: DataFrame, membership: DataFrame, weights: DataFrame, benchmark: DataFrame, industries: DataFrame, path: str, ends: tuple[str, ...], keep) -> DataFrame:
    """The history after steps that end with the given dates (Sundays, but for the last one)."""
    spark, last = bars.sparkSession, None
    for date in ends:
        state = no_state(spark, weights) if last is None else stored_state(spark, path, date)
        new = as_of(bars, date) if last is None else as_of(bars, date).where(F.col("date") > F.to_date(F.lit(last)))
        publish_step(*step(state, new, membership, as_of(benchmark, date), industries, keep), path, date)
        last = date
    return stored_history(spark, path)
