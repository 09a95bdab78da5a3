"""Indexes and exponential means in steps, against the same in one."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import bars as B
from orrery.operators import incremental, indicators, synthetic_index


def test_an_index_in_steps(spark, tmp_path):
    rng = np.random.default_rng(8)
    days = [d for i in range(260) if (d := dt.date(2021, 1, 4) + dt.timedelta(days=i)).weekday() < 5]
    rows = []
    for s in range(6):
        price = 100.0
        for i, d in enumerate(days):
            price *= 1 + rng.normal() / 50
            # gaps of every length around the longest that is filled, some across the border of two steps
            if (i // 7 + s) % 4 and not (s == 2 and 60 < i < 75) and not (s == 3 and i < 40):
                rows.append((f"S{s}", d, price))
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    membership = spark.createDataFrame([(f"S{s}", "x" if s < 4 else "y", float(s)) for s in range(6)] + [("S1", "y", 3.0)], "symbol string, industry_key string, market_cap double")
    fill = F.when(F.col("freq") == "d", 5).otherwise(2)
    series = B.close_series(bars, incremental.FREQS)
    weights = synthetic_index.weights(series, membership)
    whole = synthetic_index.synthetic_index(series, membership, fill=fill, weighted=weights)
    want = {(r.freq, r.industry_key, r.date): r for r in whole.collect()}
    state, got, last = incremental.no_state(spark, weights), {}, dt.date(1990, 1, 1)
    for end in (dt.date(2021, 4, 4), dt.date(2021, 6, 20), dt.date(2022, 1, 1)):
        new = bars.where((F.col("date") > F.lit(last)) & (F.col("date") <= F.lit(end)))
        index, closes = incremental.extended_index(state, synthetic_index.member_closes(B.close_series(new, incremental.FREQS), membership), fill)
        got |= {(r.freq, r.industry_key, r.date): r for r in index.collect()}
        state |= {"closes": _kept(closes, tmp_path / f"c{end}"), "index": _kept(state["index"].unionByName(index), tmp_path / f"i{end}")}
        last = end
    assert set(got) == set(want) and len(want) > 250
    for k, r in want.items():
        assert got[k].close == pytest.approx(r.close, rel=1e-12) and got[k].members == r.members


def _kept(frame, path):
    frame.write.parquet(str(path))
    return frame.sparkSession.read.parquet(str(path))


def test_means_go_on_from_a_state(spark):
    rng = np.random.default_rng(4)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for k in "ab" for i, x in enumerate(50 + rng.normal(size=300).cumsum())]
    frame = spark.createDataFrame(rows, "k string, date date, close double")
    whole = {(r.k, r.date): r for r in indicators.ppo_parts(frame, "k").collect()}
    first = indicators.ppo_parts(frame.where("date < '2020-05-01'"), "k")
    state = first.groupBy("k").agg(*(F.max_by(c, "date").alias(c) for c in ("fast", "slow", "signal")))
    # b has no state and starts anew
    later = {(r.k, r.date): r for r in indicators.ppo_parts(frame.where("date >= '2020-05-01'"), "k", state.where("k = 'a'")).collect()}
    for (k, d), r in later.items():
        if k == "a":
            assert (r.fast, r.slow, r.signal, r.hist) == pytest.approx((whole[k, d].fast, whole[k, d].slow, whole[k, d].signal, whole[k, d].hist), abs=1e-9)
    assert later["b", dt.date(2020, 5, 1)].fast == later["b", dt.date(2020, 5, 1)].close
    assert sum(k == "a" for k, _ in later) == 300 - 121


def test_as_of_rows(spark):
    day = lambda n: dt.date(2024, 1, n)
    series = spark.createDataFrame([("a", day(3), 1.0), ("a", day(10), 2.0), ("a", day(11), 3.0), ("b", day(25), 9.0)], "k string, date date, v double")
    dates = spark.createDataFrame([(day(n),) for n in (1, 3, 9, 10, 24, 31)], "date date")
    pick = lambda **o: {(r.k, r.date.day): r.v for r in B.snap(series, dates, ["k"], ["v"], **o).collect()}
    full = {("a", 1): None, ("a", 3): 1.0, ("a", 9): 1.0, ("a", 10): 2.0, ("a", 24): 3.0, ("a", 31): 3.0, **{("b", n): None for n in (1, 3, 9, 10, 24)}, ("b", 31): 9.0}
    assert pick() == full
    near = {k: v if k in (("a", 3), ("a", 10)) else None for k, v in full.items()}
    assert pick(tolerance=5) == near
    assert pick(tolerance=5, nulls=False) == {k: v for k, v in near.items() if v is not None}
    assert pick(nulls=False) == {k: v for k, v in full.items() if v is not None}
    plan = B.snap(series, dates, ["k"], ["v"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_snapshots_side_by_side(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, n)) for n in (1, 5, 9)], "symbol string, date date")
    got = sorted((str(r.as_of), r.date.day) for r in B.as_of_each(rows, ["2024-01-05", "2024-01-31", "2023-01-01"]).collect())
    assert got == [("2024-01-05", 1), ("2024-01-05", 5), ("2024-01-31", 1), ("2024-01-31", 5), ("2024-01-31", 9)]


def test_steps_shuffle_sums_not_closes(spark):
    """What a step's index keeps grows with pairs of dates, not with constituents."""
    written = []

    def keep(frame):
        written.append(frame.count())
        return frame

    for n in (4, 30):
        rows = [(f"S{s}", dt.date(2021, 1, 4) + dt.timedelta(days=i), 10.0 + (s * i) % 7) for s in range(n) for i in range(28)]
        bars = spark.createDataFrame(rows, "symbol string, date date, close double")
        membership = spark.createDataFrame([(f"S{s}", "x", 1.0 + s) for s in range(n)], "symbol string, industry_key string, market_cap double")
        series = B.close_series(bars, incremental.FREQS)
        state = incremental.no_state(spark, synthetic_index.weights(series, membership))
        index, _ = incremental.extended_index(state, synthetic_index.member_closes(series, membership), 5, keep)
        assert index.count() == 20 + 4
    assert written == [24, 24]
