"""Column functions shared by the operators. All are native expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Spread below which a window counts as flat.
FLAT = 1e-12

# Scores and ranks of labels.
QUADRANT_SCORE = {"Leading": 100, "Improving": 67, "Weakening": 33, "Lagging": 0}
TAIL_SCORE = {"right-up": 100, "right-down": 50, "left-up": 50, "left-down": 0, "unknown": 50}
STAGE_SCORE = {"2B": 100, "2A": 85, "2C": 70, "1": 45, "3": 25, "4": 5}
# Label of a (weekly, monthly) pair of quadrants, and the score of a label.
TIMEFRAME_LABEL = {
    ("Leading", "Leading"): "Both Leading",
    ("Improving", "Leading"): "Weekly Imp / Mo Leading",
    ("Leading", "Improving"): "Weekly Lead / Mo Imp",
    ("Improving", "Improving"): "Both Improving",
    ("Weakening", "Leading"): "Pullback (Mo Leading)",
    ("Lagging", "Leading"): "Deep Pullback (Mo Lead)",
    ("Weakening", "Improving"): "Weekly Weak / Mo Imp",
    ("Lagging", "Improving"): "Weekly Lag / Mo Imp",
    ("Leading", "Weakening"): "Weekly Lead / Mo Weak",
    ("Improving", "Weakening"): "Weekly Imp / Mo Weak",
    ("Weakening", "Weakening"): "Both Weakening",
    ("Lagging", "Weakening"): "Both Bearish",
    ("Leading", "Lagging"): "Weekly Lead / Mo Lag",
    ("Improving", "Lagging"): "Weekly Imp / Mo Lag",
    ("Weakening", "Lagging"): "Both Bearish",
    ("Lagging", "Lagging"): "Both Lagging",
}
TIMEFRAME_SCORE = {
    "Both Leading": 100,
    "Weekly Imp / Mo Leading": 85,
    "Weekly Lead / Mo Imp": 80,
    "Both Improving": 75,
    "Pullback (Mo Leading)": 60,
    "Deep Pullback (Mo Lead)": 50,
    "Weekly Weak / Mo Imp": 45,
    "Weekly Lag / Mo Imp": 40,
    "Weekly Lead / Mo Weak": 35,
    "Weekly Imp / Mo Weak": 30,
    "Both Weakening": 25,
    "Both Bearish": 10,
    "Weekly Lead / Mo Lag": 30,
    "Weekly Imp / Mo Lag": 25,
    "Both Lagging": 0,
}


def np_round(x: Column, digits: int = 0) -> Column:
    """Round half to even, as numpy does."""
    return F.rint(x * 10**digits) / 10**digits


def pct_change(new: Column, old: Column) -> Column:
    """Change in percent; null where the base is null or zero."""
    return (F.try_divide(new, old) - 1) * 100


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def scope(frame: DataFrame, *keys: str) -> list[str]:
    """The keys of a table's rows. Where it has an as_of (snapshot date) or freq column, each value of it is a table of its own:
    the column is a key of every window, group and join, so that one plan gives all of them side by side."""
    return [*(c for c in ("as_of", "freq") if c in frame.columns), *keys]


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int) -> Column:
    """A rolling aggregate over n rows, null unless all n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def sma(x: Column, w: WindowSpec, n: int) -> Column:
    return rolling(F.avg, x, w, n)


def zscore_100(x: Column, w: WindowSpec, n: int) -> Column:
    """100 plus the rolling z-score with population spread; null where the window is flat."""
    spread = rolling(F.stddev_pop, x, w, n)
    return 100 + (x - sma(x, w, n)) / F.when(spread > FLAT, spread)


def average_rank_share(x: Column, keys: Sequence[str] = ()) -> Column:
    """Average rank over the count of non-null values, null for nulls: ties share the mean of their ranks."""
    own = Window.partitionBy(*keys, x.isNull())
    place = F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2
    return F.when(x.isNotNull(), place / F.count(x).over(Window.partitionBy(*keys)))


def sctr_rank(x: Column, keys: Sequence[str] = ()) -> Column:
    """Percentile rank from 0 to 99.9."""
    return np_round(average_rank_share(x, keys) * 99.9, 1)


def percentile_1_99(x: Column, keys: Sequence[str] = ()) -> Column:
    """Percentile rank as a whole number from 1 to 99."""
    return F.rint(average_rank_share(x, keys) * 98 + 1).cast("int")


def min_rank_desc(x: Column, keys: Sequence[str] = ()) -> Column:
    """Rank from the largest value, ties take the least rank; null for nulls."""
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(x.desc_nulls_last())))


def position(*order: Column, keys: Sequence[str] = ()) -> Column:
    """Row number in a given order (name the entity key last, so that ties are settled)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def lookup(x: Column, table: dict, default=None) -> Column:
    """Value of a small literal table, or the default."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(x == key, F.lit(value)).otherwise(out)
    return out


def quadrant(ratio: Column, momentum: Column) -> Column:
    return (
        F.when(ratio.isNull() | momentum.isNull(), F.lit(None).cast("string"))
        .when((ratio >= 100) & (momentum >= 100), "Leading")
        .when(ratio >= 100, "Weakening")
        .when(momentum < 100, "Lagging")
        .otherwise("Improving")
    )


def tail_direction(ratio: Column, momentum: Column, ratio_before: Column, momentum_before: Column) -> Column:
    known = ratio_before.isNotNull()
    return F.when(~known, "unknown").otherwise(F.concat(F.when(ratio > ratio_before, "right").otherwise("left"), F.lit("-"), F.when(momentum > momentum_before, "up").otherwise("down")))


def timeframe_label(weekly: Column, monthly: Column) -> Column:
    out = F.lit("")
    for (w, m), label in TIMEFRAME_LABEL.items():
        out = F.when((weekly == w) & (monthly == m), label).otherwise(out)
    return out


def timeframe_score(label: Column) -> Column:
    return lookup(label, {k: float(v) for k, v in TIMEFRAME_SCORE.items()}, 50.0)


def stage(price: Column, s50: Column, s150: Column, s200: Column, slope: Column) -> Column:
    """Trend stage from price, moving averages and the 200-day slope; the first case that fits wins."""
    g = F.coalesce(slope, F.lit(0.0))
    above, golden, rising, flat = price > s200, s50 > s200, g > 0.05, F.abs(g) <= 0.05
    full = (price > s150) & (s150 > s200)
    return (
        F.when(above & golden & rising & full & (g < 0.15) & ~(price > s50), "2C")
        .when(above & golden & rising & full, "2B")
        .when(above & golden & rising, "2A")
        .when(above & golden & flat, "2C")
        .when(above & ~golden, "3")
        .when(~above & (s50 > s200 * 0.98) & rising, "3")
        .when(~above & ~golden & (g < 0), "4")
        .when(~above & ~golden & flat, "4")
        .otherwise("1")
    )


def quintile(pct: Column) -> Column:
    return F.when(pct >= 80, 1).when(pct >= 60, 2).when(pct >= 40, 3).when(pct >= 20, 4).otherwise(5)


def faber_signal(q: Column, above_200: Column, stage_: Column, minervini: Column) -> Column:
    return (
        F.when((q == 1) & above_200 & (stage_ == "2B") & (minervini >= 5), "STRONG BUY")
        .when((q == 1) & above_200 & stage_.isin("2A", "2B"), "BUY")
        .when(above_200 & (((q == 2) & stage_.isin("2A", "2B")) | ((q == 1) & (stage_ == "2C"))), "HOLD")
        .when((q <= 2) & (stage_ == "1") & above_200, "WATCH")
        .when((q == 1) & ~above_200, "CAUTION")
        .otherwise("EXIT")
    )


def momentum_label(pct: Column) -> Column:
    return F.when(pct.isNull(), "Unknown").when(pct >= 80, "Leader").when(pct >= 60, "Above Average").when(pct >= 40, "Average").when(pct >= 20, "Below Average").otherwise("Laggard")


def health_label(score: Column) -> Column:
    return F.when(score >= 80, "Bull Market").when(score >= 60, "Healthy").when(score >= 40, "Mixed").when(score >= 20, "Weak").otherwise("Bear Market")


def strip_suffix(label: Column) -> Column:
    """A severity label without what follows its first bracket or star."""
    return F.trim(F.regexp_replace(label, r"\s*[\(★].*$", ""))
