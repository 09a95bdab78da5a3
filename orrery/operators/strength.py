"""Relative strength: moving-average signals of the ratio, percentiles of excess returns, all-time highs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import by, np_round, pct_change, percentile_1_99, position, scope, sma
from orrery.operators.bars import align
from orrery.operators.indicators import run_length
from orrery.operators.sctr import enrich, month_ends

MA, CROSS_ROWS = 13, 2
# Order of the signals in the table.
MA_SIGNALS = ("RS Cross Up", "RS Above MA (rising)", "RS Above MA", "RS Above MA (fading)", "RS Below MA (recovering)", "RS Cross Down", "RS Below MA", "RS Below MA (falling)")


def ma_signals(history: DataFrame) -> DataFrame:
    """Where each industry's ratio stands to its 13-week mean: weeks above, fresh crosses, slope and a label."""
    k = scope(history, "industry_key")
    w = by(*k)
    rows = history.where("rs_ratio is not null").withColumn("rows", F.count("*").over(Window.partitionBy(*k))).where(F.col("rows") >= MA + 4)
    r = F.col("rs_ratio")
    rows = rows.withColumn("ma", sma(r, w, MA))
    m, r1, m1 = F.col("ma"), F.lag("rs_ratio").over(w), F.lag("ma").over(w)
    up, down = (r1 <= m1) & (r > m), (r1 >= m1) & (r < m)
    recent = w.rowsBetween(-(CROSS_ROWS - 1), 0)
    rows = rows.select(
        "*",
        run_length(r > m, k).alias("weeks_above_ma"),
        up.alias("_up"),
        down.alias("_down"),
        F.coalesce((m - F.lag("ma", 4).over(w)) / 4, F.lit(0.0)).alias("slope"),
    )
    rows = rows.select("*", F.coalesce(F.max("_up").over(recent), F.lit(False)).alias("rs_cross_up"), F.coalesce(F.max("_down").over(recent), F.lit(False)).alias("rs_cross_down"), F.row_number().over(Window.partitionBy(*k).orderBy(F.col("date").desc())).alias("_n")).where("_n = 1")
    above, s = r > m, F.col("slope")
    label = (
        F.when(F.col("rs_cross_up"), "RS Cross Up")
        .when(F.col("rs_cross_down"), "RS Cross Down")
        .when(above & (s > 0.005), "RS Above MA (rising)")
        .when(above & (s < -0.005), "RS Above MA (fading)")
        .when(above, "RS Above MA")
        .when(s < -0.005, "RS Below MA (falling)")
        .when(s > 0.005, "RS Below MA (recovering)")
        .otherwise("RS Below MA")
    )
    out = rows.select(*k, "sector_name", "industry_name", "quadrant", np_round(r, 3).alias("rs_ratio_now"), np_round(m, 3).alias("rs_ma13"), above.alias("rs_above_ma"), F.col("weeks_above_ma").cast("int").alias("weeks_above_ma"), "rs_cross_up", "rs_cross_down", np_round(s, 4).alias("rs_ma_slope"), label.alias("rs_ma_signal"))
    order = F.array_position(F.array(*map(F.lit, MA_SIGNALS)), F.col("rs_ma_signal"))
    return out.withColumn("rank", position(order, F.col("weeks_above_ma").desc(), F.col("industry_key"), keys=scope(history)))


QUARTERS = (0, 63, 126, 189, 252)
NEW_HIGH_ROWS, MIN_ROWS = 252, 262


def excess_metrics(index: DataFrame, benchmark: DataFrame, key: str = "industry_key", min_rows: int = MIN_ROWS) -> DataFrame:
    """Excess returns over 3, 6 and 12 months and by quarter, their weighted mean, and the strength line against its high."""
    k = scope(index, key)
    w = by(*k)
    rows = align(index.where("close is not null"), benchmark.where("close is not null"))
    p, b = F.col("close"), F.col("benchmark")
    lagged = rows.select("*", *(F.lag(p, n).over(w).alias(f"p{n}") for n in QUARTERS[1:]), *(F.lag(b, n).over(w).alias(f"b{n}") for n in QUARTERS[1:]), F.first(p).over(w).alias("p_first"), F.first(b).over(w).alias("b_first"))
    line = F.try_divide(p / F.col("p_first"), b / F.col("b_first"))
    lagged = lagged.withColumn("line", line).withColumn("line_high", F.max("line").over(w.rowsBetween(-(NEW_HIGH_ROWS - 1), 0)))
    lagged = lagged.withColumn("_rows", F.count("*").over(Window.partitionBy(*k))).withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("date").desc())))
    last = lagged.where((F.col("_n") == 1) & (F.col("_rows") >= min_rows)).withColumnsRenamed({"close": "p0", "benchmark": "b0"})

    def excess(new: int, old: int) -> Column:
        return np_round(pct_change(F.col(f"p{new}"), F.col(f"p{old}")) - pct_change(F.col(f"b{new}"), F.col(f"b{old}")), 4)

    quarters = last.select(
        *k,
        excess(0, 63).alias("rs_excess_3m"),
        excess(0, 126).alias("rs_excess_6m"),
        excess(0, 252).alias("rs_excess_12m"),
        excess(0, 63).alias("rs_q4"),
        excess(63, 126).alias("rs_q3"),
        excess(126, 189).alias("rs_q2"),
        excess(189, 252).alias("rs_q1"),
        pct_change(F.col("line"), F.col("line_high")).alias("_from_high"),
    )
    composite = (F.col("rs_q4") * 2 + F.col("rs_q3") + F.col("rs_q2") + F.col("rs_q1")) / 5
    off = F.abs("_from_high")
    return quarters.select("*", np_round(composite, 4).alias("rs_excess_comp"), np_round(F.col("_from_high"), 2).alias("rs_line_vs_52w"), (off <= 1.0).alias("rs_new_high"), (off <= 3.0).alias("rs_near_new_high")).drop("_from_high")


def strength_percentiles(index: DataFrame, benchmark: DataFrame, industries: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Excess metrics of each industry with 1 to 99 percentiles across all of them."""
    rows = enrich(excess_metrics(index, benchmark, "industry_key", min_rows), industries).drop("sector_key")
    for name, of in (("rs_pct_3m", "rs_excess_3m"), ("rs_pct_6m", "rs_excess_6m"), ("rs_pct_12m", "rs_excess_12m"), ("rs_pct_composite", "rs_excess_comp")):
        rows = rows.withColumn(name, percentile_1_99(F.col(of), scope(index)))
    return rows.withColumn("rank", position(F.col("rs_pct_composite").desc_nulls_last(), F.col("industry_key"), keys=scope(index)))


def ath_monitor(index: DataFrame, industries: DataFrame, min_days: int = 60, min_months: int = 6) -> DataFrame:
    """All-time-high status of each industry's month-end closes."""
    k = scope(index, "industry_key")
    held = index.withColumn("_rows", F.count("*").over(Window.partitionBy(*k))).where(F.col("_rows") >= min_days)
    months = month_ends(held, "industry_key")
    w = by(*k)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("close")
    # the first date wins among equal highs
    peak = F.max(F.struct(c.alias("close"), (-F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("neg"), F.col("date").alias("date"))).over(before)
    rows = months.withColumn("peak", peak)
    last = Window.partitionBy(*k)
    rows = rows.withColumn("n", F.count("*").over(last)).withColumn("_n", F.row_number().over(last.orderBy(F.col("date").desc())))
    rows = rows.withColumn("prev", F.last(F.col("peak.close")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    new_ath = c > F.col("prev")
    holds = c >= F.col("prev") * 0.995
    rows = rows.withColumn("_run", run_length(holds, k))
    # a month that is no new high is not counted itself, but the run up to the month before it
    rows = rows.withColumn("_run_before", F.coalesce(F.lag("_run").over(w), F.lit(0))).where((F.col("_n") == 1) & (F.col("n") >= min_months))
    level = F.greatest(c, F.col("prev"))
    pct = pct_change(c, level)
    since = F.when(new_ath, 0).otherwise(F.months_between(F.trunc("date", "month"), F.trunc(F.col("peak.date"), "month")).cast("int"))
    months_holding = F.when(new_ath, F.col("_run")).when(pct > -3.0, F.col("_run_before")).otherwise(0)
    rows = rows.select(*k, "date", c.alias("c"), "prev", new_ath.alias("new_ath"), level.alias("level"), F.when(new_ath, F.col("date")).otherwise(F.col("peak.date")).alias("ath_date"), pct.alias("pct"), since.alias("since"), months_holding.cast("int").alias("months_holding_above_prev"))
    p, s = F.col("pct"), F.col("since")
    holding = (s <= 3) & (F.col("c") >= F.col("prev") * 0.985)
    recovering = (s <= 12) & (p >= -15.0)
    signal = F.when(F.col("new_ath"), "New ATH").when(holding, "Holding Breakout").when(p >= -3.0, "Near ATH").when(recovering, "Recovering").otherwise("Below ATH")
    score = F.when(F.col("new_ath"), 100.0).when(holding, 85.0).when(p >= -3.0, 70.0).when(recovering, 40.0 + (15.0 + p) / 15.0 * 20).otherwise(F.greatest(F.lit(0.0), 20.0 + p))
    out = enrich(rows, industries).select(
        *k, "sector_name", "industry_name", np_round(F.col("c"), 2).alias("current_monthly"), np_round(F.col("level"), 2).alias("monthly_ath"), "ath_date", np_round(p, 2).alias("pct_from_ath"), s.alias("months_since_ath"),
        "new_ath", (s <= 3).alias("recent_ath"), np_round(F.col("prev"), 2).alias("prev_ath_level"), "months_holding_above_prev", signal.alias("ath_signal"), np_round(score, 1).alias("ath_score"),
    )
    return out.withColumn("rank", position(F.col("ath_score").desc(), F.col("pct_from_ath").desc(), F.col("industry_key"), keys=scope(index)))
