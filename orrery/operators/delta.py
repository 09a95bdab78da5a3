"""Changes between two severity snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import lookup, np_round, position, strip_suffix

# Order of the labels, from weakest to strongest.
SEVERITY_ORDER = ("Confirmed Exit", "Weakening", "Neutral / Watch", "Pullback in Uptrend", "Early Signal", "Confirmed", "Confirmed + ATH", "Strong Confirmed", "Strong Confirmed + ATH", "Both TF Confirmed", "Both TF Confirmed + ATH")
FABER_ORDER = ("EXIT", "CAUTION", "WATCH", "HOLD", "BUY", "STRONG BUY")
STAGE_ORDER = ("4", "3", "1", "2C", "2A", "2B")
QUADRANT_ORDER = ("Lagging", "Weakening", "Improving", "Leading")
ATH_ORDER = ("Below ATH", "Recovering", "Near ATH", "Holding Breakout", "New ATH")

LABELS = ("severity_label", "faber_signal", "stage", "quadrant", "quadrant_m", "ath_signal")
NUMBERS = ("severity_score", "minervini_count", "rs_pct_composite", "rs_pct_3m", "sctr")


def order_of(x: Column, labels: tuple[str, ...], default: int = 0) -> Column:
    return lookup(x, {label: i for i, label in enumerate(labels)}, default)


def severity_rank(label: Column) -> Column:
    """Rank of a label without its suffix; unknown ones count as neutral."""
    return order_of(strip_suffix(F.coalesce(label, F.lit(""))), SEVERITY_ORDER, 2)


def compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Full outer comparison by industry: both values, deltas, rank deltas, and whether it is new, dropped or changed."""

    def side(frame: DataFrame, suffix: str) -> DataFrame:
        labels = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"{c}{suffix}") for c in LABELS]
        return frame.select("industry_key", *labels, *(F.col(c).alias(f"{c}{suffix}") for c in NUMBERS), *(F.col(c) for c in ("industry_name", "sector_name") if not suffix))

    rows = side(current, "").join(side(previous, "_prev"), "industry_key", "full")
    for c in ("industry_name", "sector_name"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    for c in NUMBERS:
        rows = rows.withColumn(f"{c}_delta", np_round(F.col(c) - F.col(f"{c}_prev"), 2))
    for c, order in (("faber_signal", FABER_ORDER), ("stage", STAGE_ORDER), ("quadrant", QUADRANT_ORDER), ("quadrant_m", QUADRANT_ORDER), ("ath_signal", ATH_ORDER)):
        rows = rows.withColumn(f"{c}_rank_delta", order_of(F.col(c), order) - order_of(F.col(f"{c}_prev"), order))
    rows = rows.withColumn("sev_rank_delta", severity_rank(F.col("severity_label")) - severity_rank(F.col("severity_label_prev")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    moved = F.lit(False)
    for c in ("sev_rank_delta", "faber_signal_rank_delta", "stage_rank_delta", "quadrant_rank_delta"):
        moved = moved | (F.col(c) != 0)
    moved = moved | F.coalesce(F.abs("severity_score_delta") >= 2.0, F.lit(False)) | F.coalesce(F.abs("rs_pct_composite_delta") >= 5.0, F.lit(False))
    return rows.withColumn("is_new", empty("severity_label_prev")).withColumn("is_dropped", empty("severity_label")).withColumn("any_change", moved)


def narrative() -> Column:
    """One line on what changed."""

    def label(name: str, c: str) -> Column:
        now, before = F.col(c), F.col(f"{c}_prev")
        return F.when((now != before) & (before != ""), F.concat(F.lit(f"{name}: "), before, F.lit(" → "), now))

    rs, mc = F.col("rs_pct_composite_delta"), F.col("minervini_count_delta")
    whole = lambda c: F.format_string("%.0f", F.col(c).cast("double"))
    signed = lambda c: F.format_string("%+.0f", F.col(c).cast("double"))
    text = F.concat_ws(
        "  |  ",
        label("Severity", "severity_label"),
        label("Faber", "faber_signal"),
        label("Stage", "stage"),
        label("RRG", "quadrant"),
        label("RRG-M", "quadrant_m"),
        F.when(F.abs(rs) >= 5, F.concat(F.lit("RS: "), whole("rs_pct_composite_prev"), F.lit("→"), whole("rs_pct_composite"), F.lit(" ("), signed("rs_pct_composite_delta"), F.lit(")"))),
        F.when(F.abs(mc) >= 1, F.concat(F.lit("Minervini: "), whole("minervini_count_prev"), F.lit("→"), whole("minervini_count"), F.lit("/7 ("), signed("minervini_count_delta"), F.lit(")"))),
    )
    return F.when(text == "", "score change only").otherwise(text)


def signal_delta(snapshots: DataFrame, current: str | None = None, previous: str | None = None) -> DataFrame:
    """Changed industries between two snapshots of a table with an as_of column.

    ``current``: the last one by default; ``previous``: the last strictly before the current one.
    """
    dates = snapshots.select("as_of").distinct()
    now = current or dates.agg(F.max("as_of").cast("string")).first()[0]
    before = previous or dates.where(F.col("as_of") < F.to_date(F.lit(now))).agg(F.max("as_of").cast("string")).first()[0]
    rows = compare(snapshots.where(F.col("as_of") == F.to_date(F.lit(now))), snapshots.where(F.col("as_of") == F.to_date(F.lit(before))))
    kept = rows.where(F.col("any_change") & ~F.col("is_new") & ~F.col("is_dropped")).withColumn("change_summary", narrative())
    kept = kept.withColumn("curr_date", F.lit(now)).withColumn("prev_date", F.lit(before))
    return kept.withColumn("rank", position(F.col("severity_score_delta").desc_nulls_last(), F.col("industry_key")))


def crossings(compared: DataFrame) -> DataFrame:
    """(industry_key, crossing): thresholds that an industry crossed, one row each."""
    f, fp, s, sp = F.col("faber_signal"), F.col("faber_signal_prev"), F.col("stage"), F.col("stage_prev")
    con, conp = F.col("severity_label").contains("Confirmed") & ~F.col("severity_label").contains("Exit"), F.col("severity_label_prev").contains("Confirmed") & ~F.col("severity_label_prev").contains("Exit")
    found = F.array(
        F.when((f == "STRONG BUY") & (fp != "STRONG BUY"), "new STRONG BUY"),
        F.when((f != "STRONG BUY") & (fp == "STRONG BUY"), "lost STRONG BUY"),
        F.when(s.isin("2A", "2B") & ~sp.isin("2A", "2B"), "new stage 2"),
        F.when(s.isin("3", "4") & ~sp.isin("3", "4"), "dropped to stage 3/4"),
        F.when(con & ~conp, "new Confirmed"),
        F.when(~con & conp, "lost Confirmed"),
    )
    both = compared.where(~F.col("is_new") & ~F.col("is_dropped"))
    return both.select("industry_key", F.explode(F.array_compact(found)).alias("crossing"))


def moves(changed: DataFrame, n: int = 10) -> DataFrame:
    """The n largest upgrades, downgrades and lateral changes."""
    d = F.coalesce("severity_score_delta", F.lit(0.0))
    rows = changed.withColumn("direction", F.when(d > 0, "upgrade").when(d < 0, "downgrade").otherwise("lateral"))
    return rows.withColumn("place", position(F.abs(d).desc(), F.col("industry_key"), keys=["direction"])).where(F.col("place") <= n)
