"""Market breadth over the industries, overall and by sector, and its reading against the market clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import health_label, np_round, position, scope


def merged(stages: DataFrame, strength: DataFrame, momentum: DataFrame, ath: DataFrame) -> DataFrame:
    """Stage rows with the columns that the other tables add; a column that is there already is not taken again."""
    k = scope(stages, "industry_key")
    rows = stages.select(*k, "sector_name", "industry_name", "stage", "above_sma50", "above_sma150", "above_sma200", "golden_cross", "minervini_count", "stage_score")
    for other, columns in ((strength, ("rs_pct_composite", "rs_new_high", "rs_near_new_high")), (momentum, ("faber_signal", "sctr", "sctr_st")), (ath, ("ath_signal", "pct_from_ath"))):
        new = [c for c in columns if c in other.columns and c not in rows.columns]
        rows = rows.join(other.select(*k, *new), k, "left")
    return rows


def share(condition: Column) -> Column:
    """Percent of the non-null rows for which a condition holds; 0 without any."""
    return np_round(F.coalesce(F.avg(F.when(condition.isNotNull(), condition.cast("double"))) * 100, F.lit(0.0)), 1)


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _health(rows: DataFrame) -> DataFrame:
    score = F.col("stage2_pct") * 0.25 + F.col("above_sma200_pct") * 0.20 + F.col("rs_positive_pct") * 0.20 + F.col("golden_cross_pct") * 0.20 + F.col("sctr60_pct") * 0.15
    scored = rows.withColumn("health_score", np_round(score, 1))
    return scored.withColumn("health_label", health_label(F.col("health_score")))


def overall(rows: DataFrame) -> DataFrame:
    """One row of about thirty shares, means and medians, and the health score."""
    s, rs, sctr, n = F.col("stage"), F.col("rs_pct_composite"), F.col("sctr"), F.col("minervini_count")
    high, near = _is(F.col("rs_new_high")), _is(F.col("rs_near_new_high"))
    found = rows.groupBy(*scope(rows)).agg(
        F.count("*").alias("n_industries"), share(_is(s.isin("2A", "2B"))).alias("stage2_pct"), share(_is(s == "2B")).alias("stage2b_pct"), share(_is(s == "1")).alias("stage1_pct"), share(_is(s == "2C")).alias("stage2c_pct"), share(_is(s == "3")).alias("stage3_pct"), share(_is(s == "4")).alias("stage4_pct"),
        *(share(F.col(c)).alias(f"{c}_pct") for c in ("above_sma200", "above_sma150", "above_sma50", "golden_cross")),
        np_round(F.avg(n), 2).alias("minervini_avg"), share(_is(n >= 5)).alias("minervini5_pct"), share(_is(n == 7)).alias("minervini7_pct"),
        share(_is(rs >= 50)).alias("rs_positive_pct"), share(_is(rs >= 80)).alias("rs_strong_pct"), share(high).alias("rs_newhigh_pct"), share(near | high).alias("rs_nearhigh_pct"),
        share(_is(sctr >= 60)).alias("sctr60_pct"), share(_is(sctr >= 80)).alias("sctr80_pct"), np_round(F.median(sctr), 1).alias("sctr_median"),
        share(_is(F.col("faber_signal") == "STRONG BUY")).alias("faber_strongbuy_pct"), share(_is(F.col("faber_signal").isin("STRONG BUY", "BUY"))).alias("faber_buy_pct"), share(_is(F.col("faber_signal") == "EXIT")).alias("faber_exit_pct"),
        share(_is(F.col("pct_from_ath") >= -5)).alias("near_ath_pct"), share(_is(F.col("pct_from_ath") >= -0.5)).alias("at_ath_pct"),
    )
    return _health(found)


def by_sector(rows: DataFrame) -> DataFrame:
    """The main shares of each sector, ranked by health."""
    s, rs, sctr = F.col("stage"), F.col("rs_pct_composite"), F.col("sctr")
    found = rows.groupBy(*scope(rows, "sector_name")).agg(
        F.count("*").alias("n_industries"), share(_is(s.isin("2A", "2B"))).alias("stage2_pct"), share(_is(s == "2B")).alias("stage2b_pct"), share(F.col("above_sma200")).alias("above_sma200_pct"), share(F.col("golden_cross")).alias("golden_cross_pct"),
        share(_is(rs >= 50)).alias("rs_positive_pct"), share(_is(rs >= 80)).alias("rs_strong_pct"), share(_is(sctr >= 60)).alias("sctr60_pct"), np_round(F.median(sctr), 1).alias("sctr_median"), np_round(F.avg("minervini_count"), 1).alias("minervini_avg"), share(_is(F.col("faber_signal").isin("STRONG BUY", "BUY"))).alias("faber_buy_pct"),
    )
    return _health(found).withColumn("rank", position(F.col("health_score").desc(), F.col("sector_name"), keys=scope(rows)))


def metric_rows(row: DataFrame) -> DataFrame:
    """(metric, value) rows of a table with one row (one a snapshot), values as strings."""
    own = [c for c in row.columns if c not in scope(row)]
    cast = row.select(*scope(row), *(F.col(c).cast("string").alias(c) for c in own))
    return cast.unpivot(scope(row), own, "metric", "value")


def reading(overall_row: DataFrame, clock: DataFrame, lead: str) -> DataFrame:
    """Breadth with the state of the leading index and the class of their combination."""
    c = clock.where(F.col("ticker") == lead).select(F.col("state").alias("clock_state"), F.col("dd_count_25d").alias("clock_dds"))
    both = overall_row.join(F.broadcast(c), F.lit(True), "left")
    state, health = F.coalesce("clock_state", F.lit("")), F.col("health_score")
    kind = (
        F.when(state.contains("Uptrend") & (health >= 60), F.when(state.contains("Stress") | state.contains("Pressure"), "confirmed bull, distribution elevated").otherwise("confirmed bull"))
        .when(state.contains("Uptrend"), "narrow leadership")
        .when(state.contains("Rally") & (health >= 55), "rally with support")
        .when(state.contains("Rally"), "suspect rally")
        .when(state.contains("Correction"), F.when(health >= 50, "selective correction").otherwise("broad correction"))
        .otherwise("unknown")
    )
    return both.withColumn("interpretation", kind)


def change(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(metric, value, previous, delta) of the numeric metrics that both (metric, value) tables have."""
    a = current.select("metric", F.expr("try_cast(value AS double)").alias("value"))
    b = previous.select("metric", F.expr("try_cast(value AS double)").alias("previous"))
    return a.join(b, "metric").where("value is not null and previous is not null").withColumn("delta", np_round(F.col("value") - F.col("previous"), 2))
