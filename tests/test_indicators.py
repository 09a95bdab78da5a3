"""Exponential means as scans over blocks, against pandas row by row."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from orrery.operators import indicators


def series(rng, n, step):
    start = dt.date(1995, 1, 2) + dt.timedelta(days=int(rng.integers(0, 900)))
    return [(start + dt.timedelta(days=step * i), float(x)) for i, x in enumerate(100 + rng.normal(size=n).cumsum())]


@pytest.mark.parametrize("block_days", [3, 64, 512])
def test_exponential_means(spark, monkeypatch, block_days):
    monkeypatch.setattr(indicators, "BLOCK_DAYS", block_days)
    rng = np.random.default_rng(block_days)
    rows = [(k, d, x) for k, (n, step) in {"a": (700, 1), "b": (90, 30), "c": (1, 1), "d": (5, 400)}.items() for d, x in series(rng, n, step)]
    frame = spark.createDataFrame(rows, "k string, date date, close double")
    plain = {(r.k, r.date): r for r in indicators.ewm_series(frame, "k", {"e2": 2, "e12": 12, "e200": 200}).collect()}
    gated = {(r.k, r.date): r.e12 for r in indicators.ewm_series(frame, "k", {"e12": 12}, min_periods=True).collect()}
    for k, own in pd.DataFrame(rows, columns=["k", "date", "close"]).groupby("k"):
        for span in (2, 12, 200):
            want = own["close"].ewm(span=span, adjust=False).mean()
            for d, x in zip(own["date"], want, strict=True):
                assert plain[k, d][f"e{span}"] == pytest.approx(x, rel=1e-12)
        for d, x in zip(own["date"], own["close"].ewm(span=12, adjust=False, min_periods=12).mean(), strict=True):
            assert gated[k, d] is None if math.isnan(x) else gated[k, d] == pytest.approx(x, rel=1e-12)


def test_nulls_leave_the_mean(spark, monkeypatch):
    monkeypatch.setattr(indicators, "BLOCK_DAYS", 2)
    rows = [(dt.date(2024, 1, d), x) for d, x in ((1, None), (2, 4.0), (3, None), (4, None), (5, None), (6, 8.0), (9, 8.0))]
    frame = spark.createDataFrame([("a", *r) for r in rows], "k string, date date, close double")
    got = [r.e for r in indicators.ewm_series(frame, "k", {"e": 3}).orderBy("date").collect()]
    assert got == [None, 4.0, 4.0, 4.0, 4.0, 6.0, 7.0]


def test_slopes_in_plain_plans(spark):
    rng = np.random.default_rng(3)
    rows = [("a", d, x) for d, x in series(rng, 600, 1)]
    found = indicators.ppo_slope_series(spark.createDataFrame(rows, "k string, date date, close double"), "k")
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    close = pd.Series([x for _, _, x in rows])
    fast, slow = (close.ewm(span=n, adjust=False).mean() for n in (12, 26))
    ppo = (fast - slow) / slow * 100
    hist = ppo - ppo.ewm(span=9, adjust=False).mean()
    want = ((hist - hist.shift(3)) / 3).clip(-50, 50)
    got = [r.ppo_slope for r in found.orderBy("date").collect()]
    assert got[:3] == [None] * 3 and got[3:] == pytest.approx(list(want[3:]), abs=1e-9)
