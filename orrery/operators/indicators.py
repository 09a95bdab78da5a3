"""Indicator series and last values of one symbol's closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import clip, scope

FAST, SLOW, SIGNAL = 2 / 13, 2 / 27, 2 / 10


def ewm(prev: Column, x: Column, alpha: float) -> Column:
    return (1 - alpha) * prev + alpha * x


def ppo_slope(closes: Column) -> Column:
    """Three-day slope of the PPO(12, 26, 9) histogram at the end of an array of closes in date order, within -50 .. 50.

    One fold in the JVM, with the last four histogram values as state; 0 with fewer than 35 closes.
    """
    start = F.struct(*(F.lit(None).cast("double").alias(n) for n in ("fast", "slow", "signal", "h0", "h1", "h2", "h3")))

    def step(s: Column, x: Column) -> Column:
        means = F.array(F.struct(F.coalesce(ewm(s["fast"], x, FAST), x).alias("f"), F.coalesce(ewm(s["slow"], x, SLOW), x).alias("s")))

        def with_ppo(m: Column) -> Column:
            ppo = F.array(F.when(m["s"] != 0, (m["f"] - m["s"]) / m["s"] * 100))
            return F.transform(ppo, lambda p: with_signal(m, p))[0]

        def with_signal(m: Column, p: Column) -> Column:
            signal = F.array(F.coalesce(ewm(s["signal"], p, SIGNAL), p, s["signal"]))
            return F.transform(signal, lambda g: F.struct(m["f"].alias("fast"), m["s"].alias("slow"), g.alias("signal"), (p - g).alias("h0"), s["h0"].alias("h1"), s["h1"].alias("h2"), s["h2"].alias("h3")))[0]

        return F.transform(means, with_ppo)[0]

    slope = F.aggregate(closes, start, step, lambda s: (s["h0"] - s["h3"]) / 3)
    return F.when(F.size(closes) < 35, 0.0).otherwise(clip(F.coalesce(slope, F.lit(0.0)), -50.0, 50.0))


def last_closes(bars: DataFrame, key: str) -> DataFrame:
    """(key, n, close, date, sma50, sma200, closes): what the end of each series needs, in one shuffle."""
    keys = scope(bars, key)
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    ranked = bars.where("close is not null").select(*keys, "date", "close").withColumn("_n", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("date").alias("date"),
        F.max_by("close", "date").alias("close"),
        *(F.when(F.count("*") >= n, F.avg(F.when(F.col("_n") <= n, F.col("close")))).alias(f"sma{n}") for n in (50, 200)),
        F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("closes"),
    )


#: Calendar days of a block in which an exponential mean is scanned; with a row a day, weights stay far inside doubles.
BLOCK_DAYS = 512


def exponential(frame: DataFrame, keys: list[str], means: dict[str, tuple[str, int]], min_periods: bool = False, start: DataFrame | None = None) -> DataFrame:
    """``frame`` (keys, date, ...) with an exponential mean for each name in ``means``: name to (column, span of 2 or more).

    ``start`` (keys, names) gives the means before the first row, of keys that go on from an earlier table.

    An associative scan: (decay, value) pairs are combined inside blocks of a key's rows, the blocks' totals are combined in
    order, and what comes in from earlier blocks is added, decayed, to each row. Blocks are dealt out on their own, so a key's
    rows can lie in many tasks; only one row a block meets in a task of its key. The first value starts the mean; a null
    leaves it as it is.
    """
    block = [*keys, "_block"]
    w = Window.partitionBy(*block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = frame.withColumn("_block", F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / BLOCK_DAYS))
    alpha = {name: 2 / (span + 1) for name, (_, span) in means.items()}
    columns = sorted({x for x, _ in means.values()})
    counted = {x: f"_{x}_rows" for x in columns}
    rows = rows.select("*", *(F.count(x).over(w).alias(n) for x, n in counted.items()))
    keep = {name: F.pow(F.lit(1 - alpha[name]), F.col(counted[x]).cast("double")) for name, (x, _) in means.items()}
    # the block's own part of each mean: values grow by what decays them until the row
    own = [(keep[name] * F.coalesce(F.sum(F.col(x) * alpha[name] / keep[name]).over(w), F.lit(0.0))).alias(f"_{name}_own") for name, (x, _) in means.items()]
    rows = rows.select("*", *own)
    ends = rows.groupBy(*block).agg(
        *(F.max(n).alias(n) for n in counted.values()),
        *(F.min_by(x, F.when(F.col(x).isNotNull(), F.col("date"))).alias(f"_{x}_first") for x in columns),
        *(F.max_by(f"_{name}_own", "date").alias(f"_{name}_end") for name in means),
    )
    order = Window.partitionBy(*keys).orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    if start is not None:
        ends = ends.join(start.select(*keys, *(F.col(name).alias(f"_{name}_start") for name in means)), keys, "left")

    def carried(name: str, x: str) -> Column:
        first = F.first(f"_{x}_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        begin = first if start is None else F.coalesce(f"_{name}_start", first)
        steps = F.collect_list(F.struct(keep[name].alias("decay"), F.col(f"_{name}_end").alias("end"))).over(before)
        return F.aggregate(steps, begin, lambda total, step: total * step["decay"] + step["end"]).alias(f"_{name}_in")

    seen = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in counted.values()]
    ends = ends.select(*block, *(carried(name, x) for name, (x, _) in means.items()), *seen)
    rows = rows.join(ends, block)
    found = []
    for name, (x, span) in means.items():
        n = F.col(counted[x]) + F.col(f"{counted[x]}_before")
        found.append(F.when(n >= (span if min_periods else 1), F.col(f"_{name}_own") + F.col(f"_{name}_in") * keep[name]).alias(name))
    return rows.select(*frame.columns, *found)


def ewm_series(frame: DataFrame, key: str, spans: dict[str, int], min_periods: bool = False) -> DataFrame:
    """``frame`` (key, date, close, ...) with an exponential mean of the closes for each name in ``spans``."""
    return exponential(frame, scope(frame, key), {name: ("close", span) for name, span in spans.items()}, min_periods)


def ppo_parts(frame: DataFrame, key: str, start: DataFrame | None = None) -> DataFrame:
    """(key, date, close, fast, slow, signal, hist): the means of the PPO(12, 26, 9) and its histogram on every row.

    ``start``: (key, fast, slow, signal) after the last row of an earlier table that this one goes on from.
    """
    keys = scope(frame, key)
    means = exponential(frame.select(*keys, "date", "close"), keys, {"fast": ("close", 12), "slow": ("close", 26)}, start=start)
    ppo = means.withColumn("_ppo", F.when(F.col("slow") != 0, (F.col("fast") - F.col("slow")) / F.col("slow") * 100))
    return exponential(ppo, keys, {"signal": ("_ppo", 9)}, start=start).withColumn("hist", F.col("_ppo") - F.col("signal")).drop("_ppo")


def slopes(parts: DataFrame, key: str) -> DataFrame:
    """(key, date, close, ppo_slope) from ``ppo_parts``: the histogram's three-day slope, null on the first three rows."""
    keys = scope(parts, key)
    slope = (F.col("hist") - F.lag("hist", 3).over(Window.partitionBy(*keys).orderBy("date"))) / 3
    return parts.select(*keys, "date", "close", F.when(slope.isNotNull(), clip(slope, -50.0, 50.0)).alias("ppo_slope"))


def ppo_slope_series(frame: DataFrame, key: str) -> DataFrame:
    """(key, date, close, ppo_slope) of every row."""
    return slopes(ppo_parts(frame, key), key)


def run_length(flag: Column, keys: list[str], order: str = "date") -> Column:
    """Length of the run of true values that ends at each row; 0 where the flag is false or null."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), n)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n - F.coalesce(broken, F.lit(0))
