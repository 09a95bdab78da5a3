"""Rotation composite and rotation severity of industries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import QUADRANT_SCORE, TAIL_SCORE, by, clip, lookup, np_round, pct_change, position, scope, sma, timeframe_label, timeframe_score
from orrery.operators.indicators import run_length
from orrery.operators.sctr import enrich

BULLISH, BEARISH = ("Leading", "Improving"), ("Weakening", "Lagging")


def rotation_composite(scores: DataFrame, weekly: DataFrame, monthly: DataFrame | None = None, breadth: DataFrame | None = None) -> DataFrame:
    """Score rank, rotation quadrant, tail and momentum of each industry in one number, a signal and flags."""
    k = scope(scores, "industry_key")
    rows = scores.select(*k, "sector_name", "industry_name", "constituent_count", "sctr").join(weekly.select(*k, "rs_ratio", "rs_momentum", "quadrant", "tail_direction"), k)
    if monthly is not None:
        rows = rows.join(monthly.select(*k, *(F.col(c).alias(f"{c}_m") for c in ("rs_ratio", "rs_momentum", "quadrant", "tail_direction"))), k, "left")
        rows = rows.withColumn("timeframe_label", timeframe_label(F.col("quadrant"), F.col("quadrant_m"))).withColumn("timeframe_score", timeframe_score(F.col("timeframe_label")))
    else:
        rows = rows.select("*", *(F.lit(None).cast(t).alias(f"{c}_m") for c, t in (("rs_ratio", "double"), ("rs_momentum", "double"), ("quadrant", "string"), ("tail_direction", "string"))), F.lit("").alias("timeframe_label"), F.lit(50.0).alias("timeframe_score"))
    if breadth is not None:
        rows = rows.join(breadth.select(*k, "median_sctr", "pct_above_75", "pct_below_25"), k, "left")
    else:
        rows = rows.select("*", *(F.lit(None).cast("double").alias(c) for c in ("median_sctr", "pct_above_75", "pct_below_25")))
    q, t = F.col("quadrant"), F.col("tail_direction")
    score = 0.40 * (clip(F.col("sctr"), 0.0, 99.9) / 99.9 * 100) + 0.30 * lookup(q, QUADRANT_SCORE, 50) + 0.15 * lookup(t, TAIL_SCORE, 50) + 0.15 * ((clip(F.col("rs_momentum") - 100, -3.0, 3.0) + 3) / 6 * 100)
    rows = rows.withColumn("composite", np_round(score, 1))
    c = F.col("composite")
    signal = F.when((c > 70) & q.isin(*BULLISH), "Strong Rotation In").when((c > 55) & q.isin(*BULLISH), "Rotation In").when(c >= 45, "Neutral").when((c >= 30) & q.isin(*BEARISH), "Rotation Out").otherwise("Strong Rotation Out")
    flags = F.concat_ws(
        " ",
        F.when(F.col("sctr") >= 75, "SCTR↑").when(F.col("sctr") <= 25, "SCTR↓"),
        F.when(q.isin(*BULLISH), "RRG↑").when(q.isin(*BEARISH), "RRG↓"),
        F.when(t.contains("right-up"), "TAIL↑").when(t.contains("left-down"), "TAIL↓"),
        F.when(F.col("pct_above_75") >= 50, "BRD↑").when(F.col("pct_above_75") <= 20, "BRD↓"),
    )
    rows = rows.withColumn("signal", signal).withColumn("convergence", flags)
    return rows.withColumn("rank", position(c.desc(), F.col("industry_key"), keys=scope(scores)))


def history_scores(history: DataFrame) -> DataFrame:
    """Last row per industry of a weekly history with four component scores: rank momentum, persistence, transition and
    tail velocity. All share one partitioning and order, so the history is shuffled and sorted once."""
    k = scope(history, "industry_key")
    w = by(*k)
    newest = Window.partitionBy(*k).orderBy(F.col("date").desc())
    whole = Window.partitionBy(*k)
    q = F.col("quadrant")
    moved = F.col("rs_ratio").isNotNull() & F.col("rs_momentum").isNotNull()
    # rank of each row among those that have a position, so lags count positions
    place = F.sum(moved.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = history.select(*k, "date", "sctr", q, "rs_ratio", "rs_momentum", moved.alias("moved"), place.alias("place"))
    known = rows.where("quadrant is not null")
    same = known.withColumn("now", F.last("quadrant").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    same = same.withColumn("weeks", run_length(q == F.col("now"), k)).withColumn("before", F.last(F.when(q != F.col("now"), q), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_quads", F.count("*").over(whole))
    same = same.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*k, F.col("now").alias("quadrant"), F.col("weeks").cast("int").alias("weeks_in_quadrant"), F.coalesce("before", F.lit("")).alias("prev_quadrant"), "n_quads")
    tails = rows.where("moved").select(*k, "date", (F.col("rs_ratio") - F.lag("rs_ratio", 4).over(w)).alias("dx"), (F.col("rs_momentum") - F.lag("rs_momentum", 4).over(w)).alias("dy"), "rs_ratio", "rs_momentum", F.row_number().over(newest).alias("_n")).where("_n = 1").drop("_n", "date")
    trend = rows.select(*k, "sctr", F.lag("sctr", 4).over(w).alias("s4"), F.lag("sctr", 12).over(w).alias("s12"), F.count("*").over(whole).alias("n"), F.row_number().over(newest).alias("_n")).where("_n = 1").drop("_n")
    out = trend.join(same, k, "left").join(tails, k, "left")
    enough = F.col("n") >= 13
    d4, d12 = F.coalesce(F.col("sctr") - F.col("s4"), F.lit(0.0)), F.coalesce(F.col("sctr") - F.col("s12"), F.lit(0.0))
    trend_label = F.when(~enough, "insufficient").when((d4 > 2) & (d12 > 5), "accelerating").when((d4 > 2) | (d12 > 5), "rising").when((d4 < -2) & (d12 < -5), "decelerating").when((d4 < -2) | (d12 < -5), "falling").otherwise("flat")
    bullish = F.col("quadrant").isin(*BULLISH)
    weeks, now, before = F.col("weeks_in_quadrant"), F.col("quadrant"), F.col("prev_quadrant")
    persistence = F.when(now.isNull(), 50.0).when(bullish & (weeks <= 2), 65.0).when(bullish & (weeks <= 8), 70.0 + F.least(weeks - 2, F.lit(6)) * 2.5).when(bullish, F.greatest(85.0 - (weeks - 8) * 2, F.lit(50.0))).otherwise(F.greatest(35.0 - weeks * 2, F.lit(10.0)))
    entry = F.concat_ws(">", before, now)
    few = F.coalesce(F.col("n_quads"), F.lit(0)) < 2
    transition = F.when(few, "insufficient").when(before == "", F.concat_ws("-", F.lit("stable"), now)).otherwise(F.concat_ws("→", before, now))
    transition_score = (
        F.when(few, 50.0)
        .when(before == "", F.when(bullish, 70.0).otherwise(30.0))
        .when(entry == "Improving>Leading", 90.0)
        .when(entry == "Lagging>Improving", 75.0)
        .when(entry == "Weakening>Lagging", 15.0)
        .when(entry == "Leading>Weakening", 25.0)
        .when(bullish, 55.0)
        .otherwise(35.0)
    )
    dx, dy = F.col("dx"), F.col("dy")
    speed = F.sqrt(dx * dx + dy * dy)
    to_x, to_y = 101.5 - F.col("rs_ratio"), 101.5 - F.col("rs_momentum")
    cosine = (dx * to_x + dy * to_y) / ((speed + 1e-9) * (F.sqrt(to_x * to_x + to_y * to_y) + 1e-9))
    velocity = F.coalesce((F.least(speed / 0.6, F.lit(1.0)) * 0.5 + (cosine + 1) / 2 * 0.5) * 100, F.lit(50.0))
    return out.select(
        *k, np_round(F.when(enough, F.col("sctr")), 1).alias("sctr"), np_round(F.when(enough, d4), 1).alias("sctr_4w_change"), np_round(F.when(enough, d12), 1).alias("sctr_12w_change"), trend_label.alias("sctr_trend"),
        np_round(F.coalesce(F.when(enough & F.col("sctr").isNotNull(), (clip(d4 * 0.6 + d12 * 0.4, -40.0, 40.0) + 40) / 80 * 100), F.lit(50.0)), 1).alias("score_sctr_mom"),
        F.coalesce(now, F.lit("")).alias("quadrant"), F.coalesce(weeks, F.lit(0)).alias("weeks_in_quadrant"), np_round(persistence, 1).alias("score_persistence"), F.when(few, "").otherwise(before).alias("prev_quadrant"), transition.alias("transition"), transition_score.alias("score_transition"),
        np_round(dx, 3).alias("tail_dx"), np_round(dy, 3).alias("tail_dy"), np_round(speed, 3).alias("tail_speed"), F.coalesce((dx > 0) & (dy > 0), F.lit(False)).alias("toward_leading"), np_round(velocity, 1).alias("score_velocity"),
    )


def ma_structure(index: DataFrame) -> DataFrame:
    """Where each industry's level stands to its 50- and 200-day means, whether it crossed lately, and a score."""
    k = scope(index, "industry_key")
    w = by(*k)
    newest = Window.partitionBy(*k).orderBy(F.col("date").desc())
    c = F.col("close")
    rows = index.select(*k, "date", c, sma(c, w, 50).alias("m50"), sma(c, w, 200).alias("m200"), F.count("*").over(Window.partitionBy(*k)).alias("n"))
    rows = rows.select("*", F.lag("close", 14).over(w).alias("c14"), F.lag("m50", 14).over(w).alias("m14"), F.row_number().over(newest).alias("_n")).where("_n = 1 and n >= 200")
    a50, a200 = c > F.col("m50"), c > F.col("m200")
    p50, p200 = pct_change(c, F.when(F.col("m50") > 0, F.col("m50"))), pct_change(c, F.when(F.col("m200") > 0, F.col("m200")))
    crossed = (F.col("n") >= 215) & a50 & F.coalesce(F.col("c14") < F.col("m14"), F.lit(False))
    base = F.when(a50 & a200, 75.0 + F.least(F.greatest(p50, F.lit(0.0)), F.lit(10.0)) * 1.5).when(a50, 55.0).when(a200, 40.0).otherwise(F.greatest(20.0 + F.coalesce(p50, F.lit(0.0)), F.lit(5.0)))
    score = F.when(crossed, F.least(base + 10, F.lit(100.0))).otherwise(base)
    return rows.select(*k, a50.alias("above_50sma"), a200.alias("above_200sma"), crossed.alias("recent_50sma_cross"), np_round(p50, 2).alias("pct_from_50sma"), np_round(p200, 2).alias("pct_from_200sma"), np_round(score, 1).alias("score_ma"))


# Weights of the severity components.
SEVERITY_WEIGHTS = {"score_sctr_mom": 0.20, "score_persistence": 0.18, "score_transition": 0.18, "score_velocity": 0.17, "score_ma": 0.12, "score_timeframe": 0.15}


def severity_label(score: Column, weekly: Column, monthly: Column) -> Column:
    up_w, up_m, down_w, down_m = weekly.isin(*BULLISH), monthly.isin(*BULLISH), weekly.isin(*BEARISH), monthly.isin(*BEARISH)
    return (
        F.when((score >= 80) & up_w & up_m, "Both TF Confirmed")
        .when((score >= 80) & up_w, "Strong Confirmed")
        .when((score >= 65) & up_w, "Confirmed")
        .when((score >= 55) & up_w, "Early Signal")
        .when(down_w & up_m & (score >= 50), "Pullback in Uptrend")
        .when(score >= 45, "Neutral / Watch")
        .when((score < 30) & down_w & down_m, "Confirmed Exit")
        .when((score < 40) & down_w, "Weakening")
        .otherwise("Neutral / Watch")
    )


def upgraded(label: Column, ath_signal: Column, rs_pct: Column, new_high: Column) -> Column:
    """Label with what a new all-time high and a high strength percentile add to confirmed ones."""
    strong = label.isin("Both TF Confirmed", "Strong Confirmed")
    confirmed = strong | (label == "Confirmed")
    at_high = confirmed & F.coalesce(ath_signal == "New ATH", F.lit(False))
    first = F.when(at_high, F.concat(label, F.lit(" + ATH"))).otherwise(label)
    # a merely confirmed label that a new high has already raised is not raised again
    takes = confirmed & ~(at_high & ~strong)
    return F.when(takes & (rs_pct >= 90) & F.coalesce(new_high, F.lit(False)), F.concat(first, F.lit(" ★RS"))).when(takes & (rs_pct >= 80), F.concat(first, F.lit(" (RS≥80)"))).otherwise(first)


def rotation_severity(history: DataFrame, index: DataFrame, industries: DataFrame, monthly: DataFrame, ath: DataFrame, ma: DataFrame, strength: DataFrame, momentum: DataFrame, stages: DataFrame) -> DataFrame:
    """Six component scores of each industry in the history, their weighted sum, and its label with upgrades.

    The other inputs are the tables of the operators of those names; an industry that one lacks takes its defaults.
    """
    rows = history_scores(history)
    neutral = F.lit(50.0)
    k = scope(history, "industry_key")
    rows = rows.join(ma_structure(index), k, "left")
    for c in ("above_50sma", "above_200sma", "recent_50sma_cross"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(False)))
    rows = rows.withColumn("score_ma", F.coalesce("score_ma", neutral))
    rows = rows.join(monthly.select(*k, F.col("quadrant").alias("quadrant_m"), F.col("rs_ratio").alias("rs_ratio_m"), F.col("rs_momentum").alias("rs_momentum_m")), k, "left").withColumn("quadrant_m", F.coalesce("quadrant_m", F.lit("")))
    rows = rows.withColumn("timeframe_label", timeframe_label(F.col("quadrant"), F.col("quadrant_m"))).withColumn("score_timeframe", timeframe_score(F.col("timeframe_label")))
    rows = rows.withColumn("severity_score", np_round(sum(F.col(c) * w for c, w in SEVERITY_WEIGHTS.items()), 1))
    rows = rows.join(ath.select(*k, "ath_signal", "ath_score", "pct_from_ath"), k, "left").withColumn("ath_score", F.coalesce("ath_score", neutral))
    rows = rows.join(ma.select(*k, "rs_ma_signal", "rs_cross_up", "rs_cross_down", F.col("weeks_above_ma").alias("rs_weeks_above_ma")), k, "left")
    rows = rows.join(strength.select(*k, "rs_pct_composite", "rs_pct_3m", "rs_pct_12m", np_round(F.col("rs_excess_comp"), 1).alias("rs_excess_comp"), np_round(F.col("rs_line_vs_52w"), 1).alias("rs_line_vs_52w"), "rs_new_high", "rs_near_new_high"), k, "left")
    rows = rows.join(momentum.select(*k, "momentum_score", "momentum_pct", "faber_signal", np_round(F.col("sctr_st"), 1).alias("sctr_st"), np_round(F.col("st_lead"), 1).alias("st_lead"), "st_signal"), k, "left")
    rows = rows.join(stages.select(*k, "stage", "stage_score", "minervini_count"), k, "left")
    for c in ("rs_cross_up", "rs_cross_down", "rs_new_high", "rs_near_new_high"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(False)))
    for c in ("ath_signal", "rs_ma_signal", "faber_signal", "st_signal", "stage"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    label = severity_label(F.col("severity_score"), F.col("quadrant"), F.col("quadrant_m"))
    rows = enrich(rows, industries).drop("sector_key").withColumn("_label", label)
    rows = rows.withColumn("severity_label", upgraded(F.col("_label"), F.col("ath_signal"), F.col("rs_pct_composite"), F.col("rs_new_high"))).drop("_label")
    return rows.withColumn("rank", position(F.col("severity_score").desc(), F.col("industry_key"), keys=scope(history)))


__all__ = ["history_scores", "ma_structure", "rotation_composite", "rotation_severity", "severity_label", "upgraded"]
