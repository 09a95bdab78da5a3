"""Synthetic capitalisation-weighted indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import scope
from orrery.operators.bars import with_before

BASE = 1000.0


#: What ``close_series`` and ``with_before`` tell about the symbol's other rows.
HISTORY = ("before", "old", "rows")


def member_closes(bars: DataFrame, membership: DataFrame) -> DataFrame:
    """(industry_key, symbol, date, close, cap): the bars of constituents, once for each of their industries, with the columns
    of ``HISTORY`` that they have."""
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap")).otherwise(0.0)
    members = membership.where("symbol is not null and industry_key is not null").select("industry_key", "symbol", cap.alias("cap")).dropDuplicates(["industry_key", "symbol"])
    # a hashed table of each task's constituents: bars come by symbol already and are not sorted again
    return bars.select(*scope(bars), "symbol", "date", "close", *(c for c in HISTORY if c in bars.columns)).join(members.hint("shuffle_hash"), "symbol")


def _weights(closes: DataFrame, min_symbol_rows: int | Column, min_members: int) -> DataFrame:
    k = scope(closes, "industry_key")
    members = closes.where("close is not null").groupBy(*k, "symbol").agg(F.first("cap").alias("cap"), F.count("*").alias("_rows")).where(F.col("_rows") >= min_symbol_rows)
    w = Window.partitionBy(*k)
    total, count = F.sum("cap").over(w), F.count("*").over(w)
    share = F.when(total == 0, 1.0 / count).otherwise(F.try_divide(F.col("cap"), total))
    return members.select(*k, "symbol", share.alias("weight"), count.alias("members")).where(F.col("members") >= min_members)


def weights(bars: DataFrame, membership: DataFrame, min_symbol_rows: int | Column = 1, min_members: int = 3) -> DataFrame:
    """(industry_key, symbol, weight) of the constituents that have bars; equal weights where no capitalisation is known.

    Weights are fixed through time. Industries with fewer than ``min_members`` constituents with data are left out.
    """
    return _weights(member_closes(bars, membership), min_symbol_rows, min_members)


def changes(closes: DataFrame) -> DataFrame:
    """(industry_key, date, before, r, capped, n, held, cap, members): closes by their date and that of the symbol's close before.

    Sums of simple returns (``r``) and of returns times capitalisation (``capped``), counts of returns (``n``) and closes (``held``);
    ``cap`` and ``members`` of the symbols whose first close this is. An industry has at most one row for each pair of its dates,
    however many constituents it has. ``closes``: those of ``member_closes``, with ``HISTORY``.
    """
    r = F.try_divide("close", "old") - 1
    first = F.col("close").isNotNull() & F.col("before").isNull()
    return closes.groupBy(*scope(closes, "industry_key"), "date", "before").agg(
        F.sum(r).alias("r"),
        F.sum(F.col("cap") * r).alias("capped"),
        F.count(r).alias("n"),
        F.count("close").alias("held"),
        F.sum(F.when(first, F.col("cap"))).alias("cap"),
        F.count(F.when(first, 1)).alias("members"),
    )


def returns(changed: DataFrame, days: DataFrame, totals: DataFrame, fill: int | Column = 5) -> tuple[DataFrame, DataFrame]:
    """((industry_key, date, place) of every date of the index, (industry_key, date, r, n) of its weighted returns).

    The ``days`` of an industry are numbered by ``place``. A gap of up to ``fill`` of them is filled with the last close, so the
    return after it is taken from that close and those inside are zero; after a longer gap there is none. Only closes that
    are there take part: filled rows would add zeros. ``changed``: rows of ``changes``; ``totals``: (industry_key, total, members),
    the weights' divisor.
    """
    k = scope(changed, "industry_key")
    placed = days.withColumn("place", F.row_number().over(Window.partitionBy(*k).orderBy("date")))
    own = changed.where("held > 0").join(placed, [*k, "date"]).join(placed.select(*k, F.col("date").alias("before"), F.col("place").alias("_from")), [*k, "before"], "left")
    near = F.col("place") - F.col("_from") <= fill + 1
    sums = own.groupBy(*k, "date").agg(*(F.sum(F.when(near, F.col(c))).alias(c) for c in ("r", "capped", "n"))).join(totals, k)
    r = F.when(F.col("total") == 0, F.col("r") / F.col("members")).otherwise(F.try_divide("capped", "total"))
    return placed, sums.select(*k, "date", r.alias("r"), F.coalesce("n", F.lit(0)).alias("n"))


def synthetic_index(
    bars: DataFrame,
    membership: DataFrame,
    fill: int | Column = 5,
    min_members: int = 3,
    min_symbol_rows: int | Column = 1,
    min_rows: int = 1,
    grid: str = "industry",
    trim: bool = True,
    keep: Callable[[DataFrame], DataFrame] = lambda frame: frame,
    weighted: DataFrame | None = None,
) -> DataFrame:
    """(industry_key, date, close, members): a level that starts at 1000 and chains weighted simple returns.

    ``fill`` and ``min_symbol_rows`` may be columns of the table's keys, as of its frequency. Gaps of up to ``fill`` rows are filled, a return with a missing side counts as zero. ``grid`` takes the dates of the
    industry's constituents or of all symbols ("universe"). ``trim`` drops the flat rows before the first return.
    ``weighted`` may give the weights. ``keep`` may write the sums out that weights, dates and returns all start from.
    Shuffles: bars by symbol, unless they bring ``HISTORY``, and sums by (industry, date, date before) with partial ones; what follows is
    as large as dates and industries are, not as constituents.
    """
    s, k = scope(bars), scope(bars, "industry_key")
    closes = member_closes(bars if set(HISTORY) <= set(bars.columns) else with_before(bars), membership)
    if weighted is None:
        own = closes.where(F.col("rows") >= F.greatest(F.lit(1), F.lit(min_symbol_rows)))
    else:
        own = closes.drop("cap").join(weighted.select(*k, "symbol", F.col("weight").alias("cap")), [*k, "symbol"])
    changed = keep(changes(own))
    if weighted is None:
        totals = changed.groupBy(*k).agg(F.sum("cap").alias("total"), F.sum("members").alias("members")).where(F.col("members") >= min_members)
    else:
        totals = weighted.groupBy(*k).agg(F.lit(1.0).alias("total"), F.first("members").alias("members"))
    counts = totals.select(*k, "members")
    if grid == "universe":
        # an industry's level on every trading day is the result itself; days are few
        days = bars.select(*s, "date").distinct()
        days = counts.select(*k).join(days, s) if s else counts.select(*k).join(days, how="cross")
    else:
        days = changed.select(*k, "date").distinct().join(counts.select(*k), k, "left_semi")
    placed, daily = returns(changed, days, totals, fill)
    chain, whole = Window.partitionBy(*k).orderBy("date"), Window.partitionBy(*k)
    out = placed.join(daily, [*k, "date"], "left").join(counts, k)
    level = F.lit(BASE) * F.product(1 + F.coalesce("r", F.lit(0.0))).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("close", level)
    if trim:
        # the date after the first close has a return, be it the zero of a filled close
        gaps = F.lit(fill) if isinstance(fill, int) else fill
        first = F.min(F.when(F.when(gaps > 0, F.col("n").isNotNull()).otherwise(F.col("n") > 0), F.col("place") + F.when(gaps > 0, 1).otherwise(0))).over(whole)
        out = out.withColumn("_first", first).withColumn("_last", F.max("place").over(whole)).where("place >= _first - 1 and _first <= _last").drop("_first", "_last")
    if min_rows > 1:
        out = out.withColumn("_rows", F.count("*").over(whole)).where(F.col("_rows") >= min_rows)
    return out.select(*k, "date", "close", F.col("members").cast("int").alias("members"))
