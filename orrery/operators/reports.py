"""Report tables: distributions, top lists, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import np_round, position, strip_suffix
from orrery.operators.delta import severity_rank


def distribution(frame: DataFrame, *columns: str) -> DataFrame:
    """Rows per value of one or more columns."""
    return frame.groupBy(*columns).agg(F.count("*").alias("n"))


def top_per_group(frame: DataFrame, group: str, order: Column, tie: str, n: int) -> DataFrame:
    return frame.withColumn("place", position(order, F.col(tie), keys=[group])).where(F.col("place") <= n)


def top(frame: DataFrame, n: int, *order: Column) -> DataFrame:
    return frame.orderBy(*order).limit(n)


def bucket_counts(frame: DataFrame, column: str, edges: tuple[float, ...]) -> DataFrame:
    """Rows at or above each edge and below the one before; values below the last edge count under null."""
    bucket = F.lit(None).cast("double")
    for e in sorted(edges):
        bucket = F.when(F.col(column) >= e, F.lit(float(e))).otherwise(bucket)
    return frame.where(F.col(column).isNotNull()).groupBy(bucket.alias("at_least")).agg(F.count("*").alias("n"))


def strength_histogram(strength: DataFrame) -> DataFrame:
    return bucket_counts(strength, "rs_pct_composite", (90, 80, 70, 50, 1))


def new_high_counts(strength: DataFrame) -> DataFrame:
    return strength.agg(F.count_if("rs_new_high").alias("new_highs"), F.count_if("rs_near_new_high").alias("near_highs"))


def leader_distribution(leaders: DataFrame) -> DataFrame:
    return leaders.groupBy("leader_score").agg(F.count("*").alias("n"), F.median("corr_days").alias("median_days"))


def severity_distribution(severity: DataFrame) -> DataFrame:
    """Counts of the labels without their suffixes, strongest first."""
    plain = severity.select(strip_suffix(F.col("severity_label")).alias("label"))
    return plain.groupBy("label").agg(F.count("*").alias("n")).withColumn("place", position(severity_rank(F.col("label")).desc(), F.col("label")))


def criteria_table(stages: DataFrame) -> DataFrame:
    """Industries by sector and number of criteria met, 0 to 7 as columns."""
    counts = stages.groupBy("sector_name").pivot("minervini_count", list(range(8))).count().fillna(0)
    return counts.select("sector_name", *(F.col(str(i)).alias(f"met_{i}") for i in range(8)))


def full_template(stages: DataFrame) -> DataFrame:
    """Industries in stage 2B that meet all seven criteria."""
    return stages.where("stage = '2B' and minervini_count = 7")


def severity_filter(severity: DataFrame, sectors: list[str] | None = None, signals: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    out = severity
    for column, wanted in (("sector_name", sectors), ("faber_signal", signals)):
        out = out.where(F.col(column).isin(*wanted)) if wanted else out
    return out.where(strip_suffix(F.col("severity_label")).isin(*labels)) if labels else out


def stock_filter(stocks: DataFrame, composite: float = 0, criteria: int = 0, strength: int = 0, only_2b: bool = False, sctr: float = 0, earlier_sctr: float = 0, leader: int = 0, industries: list[str] | None = None) -> DataFrame:
    """Screened stocks with at least the given values; a missing value counts as 0."""
    out = stocks
    for column, least in (("composite", composite), ("minervini_count", criteria), ("rs_pct", strength), ("sctr", sctr), ("sctr_hist", earlier_sctr), ("cr_score", leader)):
        if least:
            out = out.where(F.coalesce(F.col(column).cast("double"), F.lit(0.0)) >= least)
    out = out.where("stage = '2B'") if only_2b else out
    return out.where(F.col("industry_name").isin(*industries)) if industries else out


def filter_summary(stocks: DataFrame) -> DataFrame:
    return stocks.agg(F.count("*").alias("stocks"), F.count_distinct("industry_key").alias("industries"), np_round(F.avg("composite"), 1).alias("avg_composite"), np_round(F.avg("rs_pct"), 1).alias("avg_rs"), F.count_if(F.col("cr_score") == 5).alias("full_leaders"))


def enriched_severity(severity: DataFrame, momentum: DataFrame) -> DataFrame:
    """Severity with momentum columns that it lacks."""
    new = [c for c in ("mg_pct", "mg_signal", "mg_rank", "faber_quintile", "sctr_st_raw") if c not in severity.columns]
    return severity.join(momentum.select("industry_key", *new), "industry_key", "left").withColumn("mg_signal", F.coalesce("mg_signal", F.lit("")))


def short_term_leaders(momentum: DataFrame, n: int = 15) -> DataFrame:
    return top(momentum.where("st_signal = 'ST Leading'"), n, F.col("st_lead").desc(), F.col("industry_key"))


def nine_month_leaders(momentum: DataFrame, n: int = 15) -> DataFrame:
    return top(momentum.where("mg_rank is not null"), n, F.col("mg_rank"), F.col("industry_key"))
