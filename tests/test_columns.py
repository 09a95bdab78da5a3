"""Column functions against pandas and every branch of the classifiers."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.operators import indicators
from orrery.operators.rotation import severity_label, upgraded


def test_rounding_is_half_even(spark):
    rows = spark.createDataFrame([(2.5, 0.25, 2.675)], "a double, b double, c double")
    assert tuple(rows.select(C.np_round(F.col("a")), C.np_round(F.col("b"), 1), C.np_round(F.col("c"), 2)).first()) == (2.0, 0.2, 2.68)


def test_average_rank_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, None, 5.0])], "i int, v double")
    got = [r.p for r in rows.select("i", C.average_rank_share(F.col("v")).alias("p")).orderBy("i").collect()]
    assert got == [0.25, 0.625, 0.625, None, 1.0]
    s = pd.Series([1.0, 2.0, 2.0, np.nan, 5.0]).rank(pct=True)
    assert [None if np.isnan(x) else x for x in s] == got


def series(spark, values, key="a"):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], "k string, date date, close double")


def test_rolling_needs_a_full_window(spark):
    got = [r.m for r in series(spark, [1, 2, 3, None, 5, 6, 7]).select("date", C.sma(F.col("close"), C.by("k"), 3).alias("m")).orderBy("date").collect()]
    assert got == [None, None, 2.0, None, None, None, 6.0]


def test_flat_window_has_no_zscore(spark):
    assert all(r.z is None for r in series(spark, [1000] * 12).select(C.zscore_100(F.col("close"), C.by("k"), 10).alias("z")).collect())


def test_ewm_and_ppo_slope_match_pandas(spark):
    rng = np.random.default_rng(3)
    values = 100 * np.cumprod(1 + rng.normal(0, 0.02, 120))
    frame = series(spark, values)
    got = [r.e for r in indicators.ewm_series(frame, "k", {"e": 3}).orderBy("date").collect()]
    s = pd.Series(values)
    assert np.allclose(got, s.ewm(span=3, adjust=False).mean())
    fast, slow = s.ewm(span=12, adjust=False).mean(), s.ewm(span=26, adjust=False).mean()
    ppo = (fast - slow) / slow * 100
    hist = ppo - ppo.ewm(span=9, adjust=False).mean()
    want = np.clip((hist.iloc[-1] - hist.iloc[-4]) / 3, -50, 50)
    ends = indicators.last_closes(frame, "k").select(indicators.ppo_slope(F.col("closes")).alias("p"), "sma50", "n").first()
    assert ends.p == pytest.approx(want, abs=1e-9) and ends.n == 120 and ends.sma50 == pytest.approx(s.tail(50).mean())
    assert indicators.last_closes(series(spark, values[:34]), "k").select(indicators.ppo_slope(F.col("closes")).alias("p")).first().p == 0.0


def test_run_length(spark):
    flags = [True, True, False, True, None, True, True]
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "k string, date int, f boolean")
    got = [r.n for r in rows.select("date", indicators.run_length(F.col("f"), ["k"]).alias("n")).orderBy("date").collect()]
    assert got == [1, 2, 0, 1, 0, 1, 2]


STAGES = [
    ((110, 112, 105, 100, 0.10), "2C"),
    ((110, 108, 105, 100, 0.20), "2B"),
    ((110, 108, 99, 100, 0.20), "2A"),
    ((110, 108, 105, 100, 0.01), "2C"),
    ((110, 99, 105, 100, 0.20), "3"),
    ((95, 99, 105, 100, 0.20), "3"),
    ((95, 90, 105, 100, -0.20), "4"),
    ((95, 90, 105, 100, None), "4"),
    ((95, 105, 105, 100, -0.20), "1"),
]


def test_every_stage(spark):
    rows = spark.createDataFrame([tuple(None if v is None else float(v) for v in x) for x, _ in STAGES], "p double, a double, b double, c double, g double")
    got = [r.s for r in rows.select(C.stage(*(F.col(c) for c in "pabcg")).alias("s")).collect()]
    assert got == [s for _, s in STAGES]


def test_every_faber_signal(spark):
    cases = [(1, True, "2B", 5, "STRONG BUY"), (1, True, "2A", 7, "BUY"), (2, True, "2A", 0, "HOLD"), (1, True, "2C", 0, "HOLD"), (2, True, "1", 0, "WATCH"), (1, False, "4", 0, "CAUTION"), (3, True, "2B", 7, "EXIT")]
    rows = spark.createDataFrame([c[:4] for c in cases], "q int, a boolean, s string, m int")
    assert [r.f for r in rows.select(C.faber_signal(*(F.col(c) for c in "qasm")).alias("f")).collect()] == [c[4] for c in cases]


def test_all_timeframe_pairs(spark):
    pairs = list(itertools.product(C.QUADRANT_SCORE, repeat=2))
    rows = spark.createDataFrame(pairs, "w string, m string").select("w", "m", C.timeframe_label(F.col("w"), F.col("m")).alias("l"))
    got = {(r.w, r.m): (r.l, r.s) for r in rows.select("*", C.timeframe_score(F.col("l")).alias("s")).collect()}
    assert got == {k: (v, float(C.TIMEFRAME_SCORE[v])) for k, v in C.TIMEFRAME_LABEL.items()} and len(got) == 16


def test_severity_labels_and_upgrades(spark):
    cases = [
        (85.0, "Leading", "Improving", "Both TF Confirmed"), (85.0, "Leading", "Lagging", "Strong Confirmed"), (70.0, "Improving", "", "Confirmed"), (56.0, "Leading", "", "Early Signal"), (52.0, "Lagging", "Leading", "Pullback in Uptrend"),
        (46.0, "Lagging", "Lagging", "Neutral / Watch"), (29.0, "Lagging", "Weakening", "Confirmed Exit"), (39.0, "Weakening", "Leading", "Weakening"), (42.0, "Lagging", "Lagging", "Neutral / Watch"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "s double, w string, m string")
    assert [r.l for r in rows.select(severity_label(F.col("s"), F.col("w"), F.col("m")).alias("l")).collect()] == [c[3] for c in cases]
    ups = [
        ("Confirmed", "New ATH", 95, True, "Confirmed + ATH"), ("Strong Confirmed", "New ATH", 95, True, "Strong Confirmed + ATH ★RS"), ("Confirmed", "Near ATH", 85, True, "Confirmed (RS≥80)"),
        ("Both TF Confirmed", "", 92, False, "Both TF Confirmed (RS≥80)"), ("Confirmed", "", None, True, "Confirmed"), ("Early Signal", "New ATH", 99, True, "Early Signal"),
    ]
    rows = spark.createDataFrame([c[:4] for c in ups], "l string, a string, p int, h boolean")
    out = rows.select(upgraded(*(F.col(c) for c in "laph")).alias("u"))
    assert [r.u for r in out.collect()] == [c[4] for c in ups]
    assert {r.s for r in out.select(C.strip_suffix(F.col("u")).alias("s")).collect()} >= {"Confirmed + ATH", "Strong Confirmed + ATH", "Confirmed"}
