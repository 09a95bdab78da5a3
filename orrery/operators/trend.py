"""Trend stages with the seven trend-template criteria, the momentum screen and the stock screener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import STAGE_SCORE, by, faber_signal, lookup, min_rank_desc, momentum_label, np_round, pct_change, percentile_1_99, position, quintile, scope, stage
from orrery.operators.bars import align
from orrery.operators.ranks import with_percentile, with_position
from orrery.operators.sctr import enrich, short_term_raw

MIN_DAYS, SLOPE_ROWS, YEAR = 210, 20, 252


def stage_metrics(closes: DataFrame, key: str, strength: DataFrame | None = None, min_days: int = MIN_DAYS, min_strength: int = 70) -> DataFrame:
    """Stage, criteria and 52-week metrics at the end of each series (key, date, close).

    Only the last 252 rows of a series are kept before anything is averaged. ``strength``: (key, rs_pct) for the
    seventh criterion, which is not met without it.
    """
    k = scope(closes, key)
    newest = Window.partitionBy(*k).orderBy(F.col("date").desc())
    rows = closes.where("close is not null").withColumn("_n", F.row_number().over(newest)).withColumn("_rows", F.count("*").over(Window.partitionBy(*k)))
    rows = rows.where((F.col("_n") <= YEAR) & (F.col("_rows") >= min_days))

    def mean(n: int, ago: int = 0) -> Column:
        return F.avg(F.when(F.col("_n").between(ago + 1, ago + n), F.col("close")))

    ends = rows.groupBy(*k).agg(
        F.max_by("close", "date").alias("price"),
        *(mean(n).alias(f"s{n}") for n in (50, 150, 200)),
        F.when(F.max("_n") >= 200 + SLOPE_ROWS, mean(200, SLOPE_ROWS)).alias("old200"),
        F.max("close").alias("high"),
        F.min("close").alias("low"),
    )
    if strength is not None:
        ends = ends.join(strength.select(*k, F.col("rs_pct").alias("_rs")), k, "left")
    else:
        ends = ends.withColumn("_rs", F.lit(None).cast("int"))
    price, s50, s150, s200, high, low = (F.col(c) for c in ("price", "s50", "s150", "s200", "high", "low"))
    slope = F.when(F.col("old200") > 0, np_round(pct_change(s200, F.col("old200")), 3))
    ends = ends.withColumn("slope", slope)
    g = F.coalesce(F.col("slope"), F.lit(0.0))
    from_low = F.when(low > 0, pct_change(price, low)).otherwise(0.0)
    criteria = {
        "minervini_c1_above_150": price > s150,
        "minervini_c2_above_200": price > s200,
        "minervini_c3_150_gt_200": s150 > s200,
        "minervini_c4_200_rising": g > 0,
        "minervini_c5_30pct_low": from_low >= 30,
        "minervini_c6_near_high": price >= high * 0.75,
        "minervini_c7_rs70": F.coalesce(F.col("_rs"), F.lit(0)) >= min_strength,
    }
    met = sum((F.when(c, 1).otherwise(0) for c in criteria.values()), F.lit(0))
    range_pos = F.when(high > low, (price - low) / (high - low) * 100).otherwise(50.0)
    label = stage(price, s50, s150, s200, F.col("slope"))
    return ends.select(
        *k,
        label.alias("stage"),
        lookup(label, STAGE_SCORE, 45).alias("stage_score"),
        met.alias("minervini_count"),
        *(c.alias(n) for n, c in criteria.items()),
        *(np_round(F.col(f"s{n}"), 2).alias(f"sma{n}") for n in (50, 150, 200)),
        F.col("slope").alias("sma200_slope"),
        *(np_round(pct_change(price, F.when(F.col(f"s{n}") > 0, F.col(f"s{n}"))), 2).alias(f"pct_vs_sma{n}") for n in (50, 150, 200)),
        np_round(pct_change(s50, F.when(s200 > 0, s200)), 2).alias("pct_sma50_vs_sma200"),
        np_round(high, 2).alias("high_52w"),
        np_round(low, 2).alias("low_52w"),
        np_round(range_pos, 1).alias("range_pos_52w"),
        np_round(pct_change(price, high), 2).alias("pct_from_52w_high"),
        np_round(from_low, 2).alias("pct_from_52w_low"),
        (price > s50).alias("above_sma50"),
        (price > s150).alias("above_sma150"),
        (price > s200).alias("above_sma200"),
        (s50 > s200).alias("golden_cross"),
        (s150 > s200).alias("sma150_gt_sma200"),
    )


def stage_analysis(index: DataFrame, strength: DataFrame, industries: DataFrame) -> DataFrame:
    """Stage table of the industries. ``strength``: the percentile table."""
    rs = strength.select(*scope(index, "industry_key"), F.col("rs_pct_composite").alias("rs_pct"))
    rows = enrich(stage_metrics(index, "industry_key", rs), industries).drop("sector_key")
    return rows.withColumn("rank", position(F.col("stage_score").desc(), F.col("minervini_count").desc(), F.col("industry_key"), keys=scope(index)))


STRENGTH_COLUMNS = ("rs_pct_composite", "rs_pct_3m", "rs_pct_6m", "rs_pct_12m", "rs_excess_comp", "rs_excess_3m", "rs_excess_12m", "rs_q4", "rs_q3", "rs_q2", "rs_q1", "rs_line_vs_52w", "rs_new_high", "rs_near_new_high")


def momentum_screen(strength: DataFrame, scores: DataFrame, stages: DataFrame | None, missing_stage: str = "2B") -> DataFrame:
    """Three momentum layers per industry and their weighted score.

    ``strength``, ``scores`` and ``stages`` are the percentile, industry score and stage tables. Without a stage table
    every industry is taken to be in ``missing_stage``.
    """
    s, k = scope(strength), scope(strength, "industry_key")
    rows = strength.select(*k, "sector_name", "industry_name", *STRENGTH_COLUMNS)
    rows = rows.join(scores.select(*k, "sctr", "c5_3m_roc", "c6_ppo_slope", "c2_sma200_pct"), k, "left")
    if stages is None:
        nothing = F.lit(None).cast("double")
        rows = rows.select("*", F.lit(missing_stage).alias("stage"), F.lit(0).alias("minervini_count"), F.lit(100).alias("stage_score"), nothing.alias("range_pos_52w"), nothing.alias("pct_from_52w_high"), nothing.alias("sma200_slope"))
    else:
        rows = rows.join(stages.select(*k, "stage", "minervini_count", "stage_score", "range_pos_52w", "pct_from_52w_high", "sma200_slope"), k, "left")
        rows = rows.withColumn("stage", F.coalesce("stage", F.lit("?"))).withColumn("minervini_count", F.coalesce("minervini_count", F.lit(0)))
    above = F.coalesce(F.col("c2_sma200_pct") > 0, F.lit(False))
    rows = rows.withColumn("above_200sma", above).withColumn("faber_quintile", quintile(F.col("rs_pct_12m")))
    rows = rows.withColumn("faber_signal", faber_signal(F.col("faber_quintile"), F.col("above_200sma"), F.col("stage"), F.col("minervini_count")))
    rows = rows.withColumn("mg_9m_score", F.col("rs_q1") + F.col("rs_q2") + F.col("rs_q3"))
    rows = rows.withColumn("mg_pct", percentile_1_99(F.col("mg_9m_score"), s)).withColumn("mg_rank", min_rank_desc(F.col("mg_9m_score"), s))
    rows = rows.withColumn("mg_signal", momentum_label(F.col("mg_pct"))).withColumn("sctr_st_raw", short_term_raw(F.coalesce("c5_3m_roc", F.lit(0.0)), F.coalesce("c6_ppo_slope", F.lit(0.0))))
    both = F.when(F.col("c5_3m_roc").isNotNull() & F.col("c6_ppo_slope").isNotNull(), F.col("sctr_st_raw"))
    rows = rows.withColumn("_both", both).withColumn("sctr_st", percentile_1_99(F.col("_both"), s).cast("double")).drop("_both")
    lead = F.col("sctr_st") - F.col("sctr")
    rows = rows.withColumn("st_lead", lead).withColumn("st_signal", F.when(lead >= 10, "ST Leading").when(lead <= -10, "ST Lagging").otherwise("flat"))
    rows = rows.withColumn("momentum_score", np_round(F.col("rs_pct_composite") * 0.40 + F.col("sctr") * 0.30 + F.col("sctr_st") * 0.20 + F.col("mg_pct") * 0.10, 1))
    rows = rows.withColumn("momentum_pct", percentile_1_99(F.col("momentum_score"), s))
    return rows.withColumn("rank", position(F.col("momentum_score").desc_nulls_last(), F.col("industry_key"), keys=s))


def excess_12m(closes: DataFrame, benchmark: DataFrame, key: str = "symbol", min_rows: int = 200) -> DataFrame:
    """(key, rs_12m): return over 251 rows, or since the first of 200 to 251 rows, less the benchmark's."""
    rows = align(closes.where("close is not null"), benchmark)
    w = by(key)
    p, b = F.col("close"), F.col("benchmark")
    base_p, base_b = F.coalesce(F.lag(p, 251).over(w), F.first(p).over(w)), F.coalesce(F.lag(b, 251).over(w), F.first(b).over(w))
    rows = rows.select(key, "date", np_round(pct_change(p, base_p) - pct_change(b, base_b), 2).alias("rs_12m"), F.count("*").over(Window.partitionBy(key)).alias("_rows"), F.row_number().over(Window.partitionBy(key).orderBy(F.col("date").desc())).alias("_n"))
    return rows.where((F.col("_n") == 1) & (F.col("_rows") >= min_rows)).select(key, "rs_12m")


def stock_screener(
    bars: DataFrame,
    benchmark: DataFrame,
    membership: DataFrame,
    momentum: DataFrame,
    industry_stages: DataFrame,
    leaders: DataFrame,
    scores: DataFrame,
    earlier_scores: DataFrame,
    industries: DataFrame,
    signals: tuple[str, ...] = ("STRONG BUY", "BUY"),
    stages: tuple[str, ...] = ("2A", "2B"),
    min_criteria: int = 3,
) -> DataFrame:
    """Stocks of industries with a wanted signal that are in a wanted stage, ranked by a weighted score.

    Bars are cut to the chosen industries' stocks by a semi join before any window. Strength is ranked among all screened
    stocks before the stage filter, the score after it. ``scores`` and ``earlier_scores``: (ticker, sctr).
    """
    chosen = momentum.where(F.col("faber_signal").isin(*signals)).select("industry_key", F.col("faber_signal").alias("ind_faber"))
    universe = membership.select("symbol", "industry_key").join(F.broadcast(chosen), "industry_key")
    own = bars.select("symbol", "date", "close").join(universe.select("symbol"), "symbol", "left_semi")
    rows = stage_metrics(own, "symbol").join(universe, "symbol").join(excess_12m(own, benchmark), "symbol", "left")
    rows = rows.join(industry_stages.select("industry_key", F.col("stage").alias("ind_stage")), "industry_key", "left")
    rows = rows.join(leaders.select(F.col("ticker").alias("symbol"), F.col("leader_score").alias("cr_score")), "symbol", "left")
    rows = rows.join(scores.select(F.col("ticker").alias("symbol"), "sctr"), "symbol", "left").join(earlier_scores.select(F.col("ticker").alias("symbol"), F.col("sctr").alias("sctr_hist")), "symbol", "left")
    rows = rows.withColumn("cr_score", F.coalesce("cr_score", F.lit(0))).withColumn("sctr", F.coalesce("sctr", F.lit(50.0)))
    rows = with_percentile(rows, "rs_pct", "rs_12m", "symbol")
    kept = rows.where(F.col("stage").isin(*stages) & (F.col("minervini_count") >= min_criteria))
    score = F.coalesce(F.col("rs_pct"), F.lit(50)) * 0.35 + F.col("stage_score") * 0.30 + F.col("minervini_count") / 7 * 100 * 0.15 + F.col("sctr") * 0.10 + F.col("cr_score") / 5 * 100 * 0.10
    kept = with_percentile(enrich(kept.withColumn("composite", np_round(score, 1)), industries), "composite_pct", "composite", "symbol")
    out = kept.select(
        F.col("symbol").alias("ticker"), "industry_key", "industry_name", "sector_name", "ind_faber", "ind_stage", "stage", "stage_score", "minervini_count", "rs_12m", "cr_score", "sctr", "sctr_hist",
        "pct_vs_sma200", "pct_vs_sma150", "sma200_slope", "range_pos_52w", "pct_from_52w_high", "golden_cross", "rs_pct", "composite", "composite_pct",
    )
    return with_position(out, "rank", F.col("composite").desc(), F.col("ticker"))
