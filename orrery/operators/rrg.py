"""Relative rotation: ratio and momentum against a benchmark, quadrants, tails, and the weekly history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import by, np_round, quadrant, scope, sctr_rank, sma, tail_direction, zscore_100
from orrery.operators.bars import align, snap, weekly_dates
from orrery.operators.sctr import component_series, enrich

WINDOW, ROC, SMOOTH = 10, 10, 3


def rotation(index: DataFrame, benchmark: DataFrame, key: str = "industry_key", window: int = WINDOW, roc: int = ROC, smooth: int = SMOOTH) -> DataFrame:
    """(key, date, rs_ratio, rs_momentum) on every date that both have.

    Rows without a value go before the next rolling step, so windows count values. All steps share one partitioning and
    sort order, so the series is shuffled once.
    """
    k = scope(index, key)
    w = by(*k)
    rs = align(index.where("close is not null"), benchmark.where("close is not null")).withColumn("rs", 100 * F.try_divide(F.col("close"), F.col("benchmark")))
    ratio = rs.withColumn("ratio", zscore_100(F.col("rs"), w, window)).where("ratio is not null")
    change = ratio.withColumn("roc", 100 * (F.try_divide(F.col("ratio"), F.lag("ratio", roc).over(w)) - 1))
    smoothed = sma(F.col("ratio"), w, smooth) if smooth > 1 else F.col("ratio")
    momentum = change.withColumn("rs_ratio", smoothed).withColumn("momentum", zscore_100(F.col("roc"), w, window)).where("momentum is not null")
    smoothed = sma(F.col("momentum"), w, smooth) if smooth > 1 else F.col("momentum")
    return momentum.withColumn("rs_momentum", smoothed).where("rs_ratio is not null and rs_momentum is not null").select(*k, "date", "rs_ratio", "rs_momentum")


def snapshot(series: DataFrame, industries: DataFrame, counts: DataFrame, tail: int = 4, unit: str = "w") -> DataFrame:
    """The last position of each industry with its quadrant, ``tail`` earlier positions and the tail's direction.

    ``unit`` names the tail columns: rs_ratio_1w ... for weeks, rs_ratio_1m ... for months.
    """
    k = scope(series, "industry_key")
    w = by(*k)
    r, m = F.col("rs_ratio"), F.col("rs_momentum")
    rows = series.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("date").desc())))
    tails = [F.lag(c, k).over(w).alias(f"{c}_{k}{unit}") for k in range(1, tail + 1) for c in ("rs_ratio", "rs_momentum")]
    rows = rows.select("*", *tails, tail_direction(r, m, F.lag(r, 4).over(w), F.lag(m, 4).over(w)).alias("tail_direction")).where("_n = 1")
    out = enrich(rows, industries).join(counts, k, "left")
    names = [f"{c}_{k}{unit}" for k in range(1, tail + 1) for c in ("rs_ratio", "rs_momentum")]
    return out.select(
        *k, "sector_key", "sector_name", "industry_name", "constituent_count", np_round(r, 3).alias("rs_ratio"), np_round(m, 3).alias("rs_momentum"), quadrant(r, m).alias("quadrant"), "tail_direction", *(np_round(F.col(c), 3).alias(c) for c in names)
    )


def tail_points(positions: DataFrame, tail: int = 4, unit: str = "w") -> DataFrame:
    """(industry_key, step, rs_ratio, rs_momentum) of each position, oldest first, the current one last."""
    points = [F.struct(F.lit(-k).alias("step"), F.col(f"rs_ratio_{k}{unit}").alias("rs_ratio"), F.col(f"rs_momentum_{k}{unit}").alias("rs_momentum")) for k in range(tail, 0, -1)]
    points.append(F.struct(F.lit(0).alias("step"), F.col("rs_ratio"), F.col("rs_momentum")))
    return positions.select("industry_key", F.explode(F.array(*points)).alias("p")).select("industry_key", "p.*").where("rs_ratio is not null")


def history(daily_index: DataFrame, weekly_rotation: DataFrame, industries: DataFrame, start: str | None = None) -> DataFrame:
    """One row per industry and week: score rank among all industries that week, rotation, quadrant, tail direction.

    Daily raw scores count for a week within 5 days, rotation within 30; weeks with neither are left out. All weeks are
    computed at once.
    """
    dates = weekly_dates(daily_index.select(*scope(daily_index), "date"), start)
    return history_rows(component_series(daily_index), weekly_rotation, dates, industries)


def history_rows(series: DataFrame, weekly_rotation: DataFrame, dates: DataFrame, industries: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The history of some weeks (``dates``), from component series and rotation that reach back far enough for them.

    ``before``: the last four rows of each industry in the history that these weeks follow.
    """
    k = scope(series, "industry_key")
    raw = snap(series, dates, k, ["raw_score"], 5, nulls=False)
    ranked = raw.withColumn("sctr", sctr_rank(F.col("raw_score"), scope(series, "date")))
    turned = snap(weekly_rotation, dates, k, ["rs_ratio", "rs_momentum"], 30, nulls=False)
    both = ranked.join(turned, [*k, "date"], "full").where("sctr is not null or rs_ratio is not null")
    r, m, w = F.col("rs_ratio"), F.col("rs_momentum"), by(*k)
    out = both.withColumn("quadrant", quadrant(r, m)).withColumn("rs_ratio", np_round(r, 3)).withColumn("rs_momentum", np_round(m, 3))
    if before is not None:
        out = out.withColumn("_new", F.lit(True)).unionByName(before.select(*k, "date", "rs_ratio", "rs_momentum"), allowMissingColumns=True)
    out = out.withColumn("tail_direction", tail_direction(r, m, F.lag(r, 4).over(w), F.lag(m, 4).over(w)))
    named = enrich(out if before is None else out.where("_new"), industries)
    return named.select("date", *k, "sector_name", "industry_name", "sctr", np_round(F.col("raw_score"), 4).alias("raw_score"), "rs_ratio", "rs_momentum", "quadrant", "tail_direction")


def wide(history_rows: DataFrame, value: str, industries: list[str]) -> DataFrame:
    """A date by industry table of one history column; the industries are named, so no pass looks for them."""
    return history_rows.groupBy("date").pivot("industry_name", industries).agg(F.first(value))


def history_stats(history_rows: DataFrame) -> DataFrame:
    return history_rows.agg(F.count("*").alias("rows"), F.count_distinct("date").alias("dates"), F.count_distinct("industry_key").alias("industries"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def latest_top(history: DataFrame, n: int = 10) -> DataFrame:
    """The best scores of the last week of the history."""
    last = history.agg(F.max("date")).first()[0]
    return history.where((F.col("date") == F.lit(last)) & F.col("sctr").isNotNull()).orderBy(F.col("sctr").desc(), "industry_key").limit(n)
