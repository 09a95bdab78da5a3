"""Correction windows and the stocks that lead through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import by, clip, np_round, pct_change, sma
from orrery.operators.indicators import ewm_series
from orrery.operators.ranks import with_position
from orrery.operators.sctr import enrich


def drawdown_window(benchmark: DataFrame, end: str | None = None, depth: float = 5.0, no_data_days: int = 60, no_run_days: int = 30) -> DataFrame:
    """One row (start, end): the last run of days at least ``depth`` percent under the running high before the end.

    ``end``: the last follow-through day; the last date without one. Without such a run the window is the 30 days before
    the end, without bars up to it 60.
    """
    upto = benchmark.where("close is not null") if end is None else benchmark.where((F.col("date") <= F.to_date(F.lit(end))) & F.col("close").isNotNull())
    last = F.max("date") if end is None else F.to_date(F.lit(end))
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = upto.withColumn("deep", pct_change(F.col("close"), peak) <= -depth)
    rows = rows.withColumn("run", F.sum(F.when(F.col("deep"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = upto.agg(last.alias("end"), F.count("*").alias("n"))
    deep = rows.where("deep").crossJoin(F.broadcast(ends)).where("date < end")
    runs = deep.groupBy("run").agg(F.min("date").alias("start")).agg(F.max_by("start", "run").alias("start"))
    fallback = F.date_sub("end", F.when(F.col("n") == 0, no_data_days).otherwise(no_run_days))
    return ends.crossJoin(F.broadcast(runs)).select(F.coalesce("start", fallback).alias("start"), "end")


def clock_window(benchmark: DataFrame, traced: DataFrame, **options) -> DataFrame:
    """The drawdown window that ends at the last follow-through day of ``traced`` (the clock's trace of one index)."""
    end = traced.where("event = 'Follow-Through'").agg(F.max("date").cast("string")).first()[0]
    return drawdown_window(benchmark, end, **options)


def peak_window(benchmark: DataFrame, rows: int = 60, drop: float = 2.0) -> DataFrame:
    """One row (start, end) from the day after the highest close of the last ``rows`` to the last; none if the last close
    is less than ``drop`` percent below that high."""
    newest = Window.partitionBy(F.lit(1)).orderBy(F.col("date").desc())
    recent = benchmark.where("close is not null").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= rows)
    # the first of equal highs
    top = F.max(F.struct("close", "_n", "date"))
    found = recent.agg(top.alias("top"), F.max_by("close", "date").alias("last"), F.max("date").alias("end"))
    found = found.where((F.col("top.close") - F.col("last")) / F.col("top.close") * 100 >= drop)
    after = recent.crossJoin(F.broadcast(found.select(F.col("top.date").alias("top"), "end"))).where(F.col("date") > F.col("top"))
    return after.groupBy("end").agg(F.min("date").alias("start")).select("start", "end")


def _bounds(window: DataFrame) -> tuple:
    row = window.first()
    return (row.start, row.end) if row else (None, None)


def _above(x: Column, mean: Column) -> Column:
    """Whether a price is above a mean of prices; one that differs by rounding errors only is not."""
    return x > np_round(mean, 9)


def _accumulation(own: Column, prev: Column) -> tuple[Column, Column]:
    volume = F.coalesce("volume", F.lit(0.0))
    return F.coalesce(F.sum(F.when(own > prev, volume)), F.lit(0.0)), F.coalesce(F.sum(F.when(own < prev, volume)), F.lit(0.0))


def closing_range_leaders(bars: DataFrame, benchmark: DataFrame, window: DataFrame, membership: DataFrame, momentum: DataFrame, industries: DataFrame, industry_keys: DataFrame | None = None, min_score: int = 3, min_days: int = 8, warmup_days: int = 60) -> DataFrame:
    """Stocks scored from 0 to 5 through a correction window (one row: start, end), at least ``min_score``.

    Bars are cut to the window and its warm-up, and to the wanted industries, before any window function. Criteria:
    closing ranges, days above the 21-day mean, strength line up, above the 50-day mean at the end, up over down volume.
    """
    start, end = _bounds(window)
    members = membership.where("symbol is not null").select("symbol", "industry_key").distinct()
    if industry_keys is not None:
        members = members.join(F.broadcast(industry_keys.select("industry_key").distinct()), "industry_key", "left_semi")
    cut = bars.where(F.col("date").between(F.date_sub(F.lit(start), warmup_days), F.lit(end)) & (F.col("high") > F.col("low"))).select("symbol", "date", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    cut = cut.join(members.select("symbol").distinct(), "symbol", "left_semi")
    rows = ewm_series(cut, "symbol", {"ema21": 21})
    spy = benchmark.where(F.col("date").between(F.date_sub(F.lit(start), warmup_days), F.lit(end))).select("date", F.when(F.col("close") != 0, F.col("close")).alias("spy"))
    w = by("symbol")
    rows = rows.join(F.broadcast(spy), "date", "left").withColumn("spy", F.last("spy", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("sma50", sma(F.col("close"), w, 50)).withColumn("cr", F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")) * 100).withColumn("rs", F.try_divide(F.col("close"), F.col("spy")))
    inside = rows.where(F.col("date") >= F.lit(start)).withColumn("prev", F.lag("close").over(w))
    up, down = _accumulation(F.col("close"), F.col("prev"))
    scored = inside.groupBy("symbol").agg(
        F.count("*").alias("corr_days"),
        F.count(F.when(F.col("cr") >= 60.0, 1)).alias("cr_strong_days"),
        F.count(F.when(_above(F.col("close"), F.col("ema21")), 1)).alias("above_ema"),
        F.min_by("rs", "date").alias("rs0"),
        F.max_by("rs", "date").alias("rs1"),
        F.max_by("close", "date").alias("c1"),
        F.max_by("sma50", "date").alias("m1"),
        F.avg("cr").alias("cr_mean"),
        up.alias("up"),
        down.alias("down"),
    ).where(F.col("corr_days") >= min_days)
    n, c1, m1, rs0, rs1 = (F.col(c) for c in ("corr_days", "c1", "m1", "rs0", "rs1"))
    no = F.lit(False)
    flags = {
        "f1_cr": F.col("cr_strong_days") / n >= 0.60,
        "f2_ema21": F.col("above_ema") / n >= 0.70,
        "f3_rs_spy": F.coalesce((rs0 > 0) & (rs1 > rs0), no),
        "f4_above_50sma": F.coalesce(_above(c1, m1), no),
        "f5_accum": F.col("up") > F.col("down"),
    }
    total = sum((F.when(f, 1).otherwise(0) for f in flags.values()), F.lit(0))
    out = scored.select(
        F.col("symbol").alias("ticker"), total.alias("leader_score"), *(f.alias(k) for k, f in flags.items()), np_round(F.col("cr_mean"), 1).alias("cr_mean"), F.col("cr_strong_days").cast("int").alias("cr_strong_days"), n.cast("int").alias("corr_days"),
        np_round(F.col("above_ema") / n * 100, 1).alias("ema21_held_pct"), np_round(F.when(rs0 > 0, pct_change(rs1, rs0)), 2).alias("rs_chg_pct"), np_round(F.when(m1 > 0, pct_change(c1, m1)), 2).alias("pct_vs_sma50"), np_round(F.try_divide(F.col("up"), F.col("up") + F.col("down")) * 100, 1).alias("up_vol_pct"),
    ).where(F.col("leader_score") >= min_score)
    named = enrich(out.join(members.withColumnRenamed("symbol", "ticker"), "ticker"), industries).drop("sector_key")
    named = named.join(F.broadcast(momentum.select("industry_key", "faber_signal")), "industry_key", "left").withColumn("faber_signal", F.coalesce("faber_signal", F.lit("")))
    return with_position(named, "rank", F.col("leader_score").desc(), F.col("cr_mean").desc(), F.col("ticker"), F.col("industry_key"))


def correction_leaders(bars: DataFrame, benchmark: DataFrame, window: DataFrame, scores: DataFrame, membership: DataFrame, industries: DataFrame, min_sctr: float = 60.0, min_share: float = 0.50, min_rows: int = 200, min_days: int = 3) -> DataFrame:
    """Stocks of a high technical rank with five leadership signals through a correction window, by weighted score.

    ``scores``: (ticker, cap_bucket, sctr). Only candidates' bars are read (semi join); all signals come from one pass of
    windows over them and one aggregation.
    """
    start, end = _bounds(window)
    candidates = scores.where(F.col("sctr") >= min_sctr).select(F.col("ticker").alias("symbol"), "cap_bucket", "sctr")
    own = bars.where(F.col("date") <= F.lit(end)).select("symbol", "date", "high", "low", "close", "volume").join(candidates.select("symbol"), "symbol", "left_semi").where("close is not null")
    rows = ewm_series(own, "symbol", {"ema21": 21}, min_periods=True)
    w, c = by("symbol"), F.col("close")
    rows = rows.join(F.broadcast(benchmark.select("date", F.col("close").alias("spy"))), "date", "left")
    inside, before = F.col("date") >= F.lit(start), F.col("date") < F.lit(start)
    prev = F.when(F.lag("date").over(w) >= F.lit(start), F.lag(c).over(w))
    rows = rows.select(
        "symbol", "date", "high", "close", "volume", "ema21", inside.alias("inside"), prev.alias("prev"), sma(c, w, 50).alias("sma50"), sma(c, w, 200).alias("sma200"), F.lag(c, 63).over(w).alias("c63"),
        F.when(F.col("high") > F.col("low"), (c - F.col("low")) / (F.col("high") - F.col("low")) * 100).alias("cr"), F.try_divide(c, F.col("spy")).alias("rs"), before.alias("before"), (before & (F.col("date") >= F.date_sub(F.lit(start), 30))).alias("just_before"),
    )
    i, pre = F.col("inside"), F.when(F.col("before"), F.col("date"))
    volume = F.coalesce("volume", F.lit(0.0))
    rs_date = F.when(i & F.col("rs").isNotNull(), F.col("date"))
    a = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count(F.when(i, 1)).alias("days"), F.count(F.when(i, F.col("cr"))).alias("cr_n"), F.count(F.when(i & (F.col("cr") > 60.0), 1)).alias("cr_up"), F.count(F.when(i & _above(c, F.col("ema21")), 1)).alias("ema_up"),
        F.max_by("close", "date").alias("last"), *(F.max_by(m, "date").alias(f"last_{m}") for m in ("ema21", "sma50", "sma200")), F.count(rs_date).alias("rs_n"), F.min_by("rs", rs_date).alias("rs0"), F.max_by("rs", rs_date).alias("rs1"),
        F.count(pre).alias("pre_n"), F.max_by("close", pre).alias("pre_c"), F.max_by("sma50", pre).alias("pre_m"), F.max_by("c63", pre).alias("pre_63"),
        F.coalesce(F.sum(F.when(i & (c > F.col("prev")), volume)), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(i & (c < F.col("prev")), volume)), F.lit(0.0)).alias("down"), F.max(F.when(i, F.col("high"))).alias("top"), F.max(F.when(F.col("just_before"), c)).alias("pre_high"),
    ).where((F.col("n") >= min_rows) & (F.col("days") >= min_days) & (F.col("cr_n") > 0))
    no, last = F.lit(False), F.col("last")
    a = a.join(candidates, "symbol").select(
        "*",
        (F.col("cr_up") / F.col("cr_n")).alias("cr_share"),
        (F.col("ema_up") / F.col("days")).alias("ema_share"),
        F.when((F.col("rs_n") >= 2) & (F.col("rs0") > 0), pct_change(F.col("rs1"), F.col("rs0"))).alias("rs_change"),
        F.coalesce((F.col("pre_n") >= 65) & _above(F.col("pre_c"), F.col("pre_m")), no).alias("pre_above"),
        F.coalesce((F.col("pre_n") >= 65) & (F.col("pre_63") > 0) & (F.col("pre_c") > F.col("pre_63")), no).alias("pre_roc"),
        F.when(F.col("days") >= 2, F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(2.0)).alias("acc"),
    )
    signals = F.col("pre_above").cast("int") + F.col("pre_roc").cast("int")
    rs_score = F.coalesce(clip(50 + F.col("rs_change") * 10, 0.0, 100.0), F.lit(50.0))
    volume_score = F.coalesce(clip(60 + (F.col("acc") - 1.0) * 30, 0.0, 100.0), F.lit(50.0))
    composite = F.col("cr_share") * 100 * 0.25 + rs_score * 0.22 + F.col("ema_share") * 100 * 0.18 + signals / 2.0 * 100 * 0.15 + volume_score * 0.12 + F.least(F.col("sctr"), F.lit(99.9)) * 0.08
    held, positive, strong, gathering = F.col("ema_share") >= 0.70, F.coalesce(F.col("rs_change") > 0, no), signals >= 2, F.coalesce(F.col("acc") >= 1.0, no)
    passed = sum((F.when(f, 1).otherwise(0) for f in (F.col("cr_share") >= min_share, held, positive, strong, gathering)), F.lit(0))
    out = a.select(
        F.col("symbol").alias("ticker"), "cap_bucket", np_round(F.col("sctr"), 1).alias("sctr"), F.col("days").cast("int").alias("corr_days"), np_round(F.col("cr_share") * 100, 1).alias("cr_above_60_pct"), np_round(F.col("ema_share") * 100, 1).alias("ema21_pct"), held.alias("held_21ema"),
        F.coalesce(_above(last, F.col("last_ema21")), no).alias("above_21ema"), F.coalesce(_above(last, F.col("last_sma50")), no).alias("above_50sma"), F.coalesce(_above(last, F.col("last_sma200")), no).alias("above_200sma"), np_round(F.col("rs_change"), 2).alias("rs_change_pct"), positive.alias("rs_positive"),
        strong.alias("was_strong_pre"), F.col("pre_above").alias("was_above_50sma_pre"), F.col("pre_roc").alias("roc_3m_positive_pre"), np_round(F.col("acc"), 2).alias("acc_ratio"), gathering.alias("is_accumulating"), passed.alias("filters_passed"),
        np_round(pct_change(last, F.col("top")), 1).alias("drawdown_pct"), np_round(pct_change(last, F.col("pre_high")), 1).alias("vs_pre_high_pct"), np_round(composite, 1).alias("composite"),
    ).where(F.col("above_50sma") & (F.col("cr_above_60_pct") >= min_share * 100))
    member = membership.groupBy(F.col("symbol").alias("ticker")).agg(F.min("industry_key").alias("industry_key"))
    named = enrich(out.join(member, "ticker", "left"), industries).drop("sector_key")
    return with_position(named, "rank", F.col("composite").desc(), F.col("ticker"))
