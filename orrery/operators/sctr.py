"""Technical rank scores of stocks, published indexes and synthetic industry indexes, and their breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import by, min_rank_desc, np_round, pct_change, scope, sctr_rank, sma
from orrery.operators.bars import filled
from orrery.operators.indicators import last_closes, ppo_parts, ppo_slope, slopes

# Weights of the components.
WEIGHTS = {"c1_14m_roc": 0.30, "c2_sma200_pct": 0.15, "c3_9m_roc": 0.15, "c4_sma50_pct": 0.15, "c5_3m_roc": 0.10, "c6_ppo_slope": 0.15}
MONTHS = {"c1_14m_roc": 14, "c3_9m_roc": 9, "c5_3m_roc": 3}
MIN_DAYS, MIN_MONTHS = 210, 15


def month_ends(daily: DataFrame, key: str) -> DataFrame:
    """(key, date, close): the last close of each month under the month's end; a month that is not over counts."""
    return daily.where("close is not null").groupBy(*scope(daily, key), F.last_day("date").alias("date")).agg(F.max_by("close", F.col("date")).alias("close"))


def raw_scores(daily: DataFrame, key: str = "symbol", monthly: DataFrame | None = None, min_days: int = MIN_DAYS, min_months: int = MIN_MONTHS) -> DataFrame:
    """The six components and the raw score of each series with enough history, as of its last row.

    ``daily`` and ``monthly``: (key, date, close). Without ``monthly`` months are resampled from the daily closes.
    """
    ends = last_closes(daily, key).where(F.col("n") >= min_days)
    months = monthly if monthly is not None else month_ends(daily, key)
    k = scope(daily, key)
    w = by(*k)
    months = months.where("close is not null").withColumn("m", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("date").desc())))
    months = months.select(*k, "m", *(pct_change(F.col("close"), F.lag("close", n).over(w)).alias(c) for c, n in MONTHS.items()), F.count("close").over(Window.partitionBy(*k)).alias("months"))
    months = months.where((F.col("m") == 1) & (F.col("months") >= min_months)).drop("m", "months")
    both = ends.join(months, k)
    parts = both.select(
        *k,
        "date",
        "close",
        *MONTHS,
        pct_change(F.col("close"), F.col("sma200")).alias("c2_sma200_pct"),
        pct_change(F.col("close"), F.col("sma50")).alias("c4_sma50_pct"),
        ppo_slope(F.col("closes")).alias("c6_ppo_slope"),
    ).dropna(subset=[*MONTHS, "c2_sma200_pct", "c4_sma50_pct"])
    raw = sum(F.col(c) * w for c, w in WEIGHTS.items())
    return parts.select(*k, "date", *(np_round(F.col(c), 4).alias(c) for c in WEIGHTS), np_round(raw, 4).alias("raw_score"))


def index_sctr(daily: DataFrame, industries: DataFrame, prefix: str = "^YH", monthly: DataFrame | None = None) -> DataFrame:
    """Scores of published industry indexes (symbols with a prefix), ranked in one universe."""
    scored = raw_scores(daily.where(F.col("symbol").startswith(prefix)), "symbol", monthly)
    dim = industries.select("symbol", "industry_key", F.col("sector_name").alias("gics_sector"), "industry_name")
    out = scored.join(dim, "symbol", "left")
    out = out.withColumn("industry_key", F.coalesce("industry_key", F.lit(""))).withColumn("gics_sector", F.coalesce("gics_sector", F.lit(""))).withColumn("industry_name", F.coalesce("industry_name", "symbol"))
    out = out.withColumn("sctr", sctr_rank(F.col("raw_score"), scope(daily)))
    return out.withColumn("rank", min_rank_desc(F.col("sctr"), scope(daily)))


def industry_sctr(index: DataFrame, industries: DataFrame) -> DataFrame:
    """Scores of synthetic industry indexes (industry_key, date, close, members), ranked in one universe."""
    scored = raw_scores(index, "industry_key")
    k = scope(index, "industry_key")
    counts = index.groupBy(*k).agg(F.max("members").alias("constituent_count"))
    out = enrich(scored, industries).join(counts, k)
    out = out.withColumn("sctr", sctr_rank(F.col("raw_score"), scope(index)))
    return out.withColumn("rank", min_rank_desc(F.col("sctr"), scope(index)))


def enrich(frame: DataFrame, industries: DataFrame) -> DataFrame:
    """Sector and industry names from the (small) dimension; '' and the key where it has none."""
    dim = industries.select("industry_key", "sector_key", "sector_name", "industry_name").dropDuplicates(["industry_key"])
    out = frame.join(dim, "industry_key", "left")
    return out.withColumn("sector_key", F.coalesce("sector_key", F.lit(""))).withColumn("sector_name", F.coalesce("sector_name", F.lit(""))).withColumn("industry_name", F.coalesce("industry_name", F.col("industry_key").cast("string")))


def stock_sctr(daily: DataFrame, universe: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Scores of the universe's stocks, ranked inside their capitalisation bucket."""
    scored = raw_scores(daily.join(universe.select(F.col("ticker").alias("symbol")), "symbol", "left_semi"), "symbol", monthly)
    out = scored.withColumnRenamed("symbol", "ticker").join(universe.select("ticker", F.col("group_name").alias("cap_bucket"), "market_cap"), "ticker")
    keys = scope(daily, "cap_bucket")
    out = out.withColumn("sctr", sctr_rank(F.col("raw_score"), keys))
    return out.withColumn("rank_in_bucket", min_rank_desc(F.col("sctr"), keys))


def industry_breadth(stock_scores: DataFrame, membership: DataFrame) -> DataFrame:
    """Stock scores by industry: count, median, mean and shares above 75, above 50 and below 25."""
    members = membership.where("industry_key is not null").select(F.col("symbol").alias("ticker"), "industry_key", "sector_name", "industry_name")
    joined = stock_scores.select(*scope(stock_scores), "ticker", "sctr").join(members, "ticker")

    def share(condition: Column) -> Column:
        return np_round(F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100, 1)

    s = F.col("sctr")
    return joined.groupBy(*scope(stock_scores), "industry_key", "sector_name", "industry_name").agg(
        F.count("*").alias("count"),
        np_round(F.median("sctr"), 1).alias("median_sctr"),
        np_round(F.avg("sctr"), 1).alias("mean_sctr"),
        share(s > 75).alias("pct_above_75"),
        share(s > 50).alias("pct_above_50"),
        share(s < 25).alias("pct_below_25"),
    )


def bucket_summary(stock_scores: DataFrame) -> DataFrame:
    return stock_scores.groupBy("cap_bucket").agg(F.count("*").alias("stocks"), np_round(F.median("sctr"), 1).alias("median_sctr"), F.max("sctr").alias("max_sctr"))


def component_series(index: DataFrame, key: str = "industry_key", parts: DataFrame | None = None) -> DataFrame:
    """The six components and the raw score of every day, null where history is short.

    Monthly changes count from the end of their month on: a day takes those of its own month only if it is the month's
    last calendar day, else those of the month before. ``parts``: the rows of ``ppo_parts``, where they are known.
    """
    k = scope(index, key)
    w = by(*k)
    months = month_ends(index, key)
    months = months.select(*k, F.col("date").alias("_month"), *(pct_change(F.col("close"), F.lag("close", n).over(w)).alias(c) for c, n in MONTHS.items()))
    days = slopes(ppo_parts(index, key) if parts is None else parts, key)
    days = days.withColumn("_month", F.when(F.col("date") == F.last_day("date"), F.col("date")).otherwise(F.last_day(F.add_months("date", -1))))
    # a month without bars takes the changes of the month before it
    joined = days.join(months, [*k, "_month"], "left")
    for c in MONTHS:
        joined = joined.withColumn(c, filled(F.col(c), k, 31))
    joined = joined.withColumn("c2_sma200_pct", pct_change(F.col("close"), sma(F.col("close"), w, 200))).withColumn("c4_sma50_pct", pct_change(F.col("close"), sma(F.col("close"), w, 50))).withColumnRenamed("ppo_slope", "c6_ppo_slope")
    raw = sum(F.col(c) * v for c, v in WEIGHTS.items())
    return joined.select(*k, "date", "close", *WEIGHTS, raw.alias("raw_score"))


def score_agreement(computed: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: how many names two score tables (name, sctr) share, and the rank correlation of their scores."""
    from orrery.functions.columns import average_rank_share

    a = computed.select(F.lower(F.trim("name")).alias("name"), F.col("sctr").alias("a"))
    b = listed.select(F.lower(F.trim("name")).alias("name"), F.col("sctr").alias("b"))
    both = a.join(b, "name").where("a is not null and b is not null")
    ranks = both.select(average_rank_share(F.col("a")).alias("ra"), average_rank_share(F.col("b")).alias("rb"))
    return ranks.agg(F.count("*").alias("n"), np_round(F.corr("ra", "rb"), 6).alias("spearman"))


def short_term_raw(roc_3m, slope, roc_weight: float = 0.40, slope_weight: float = 0.60):
    """Raw short-term score of the two fast components; null if either is."""
    return roc_3m * roc_weight + slope * slope_weight


__all__ = ["bucket_summary", "component_series", "enrich", "index_sctr", "industry_breadth", "industry_sctr", "month_ends", "raw_scores", "score_agreement", "short_term_raw", "stock_sctr"]
