"""Closes of all frequencies and dates from one shuffle, and the sums that indexes start from."""

import datetime as dt
import random

from pyspark.sql import functions as F

from orrery.operators import bars as B
from orrery.operators import synthetic_index
from orrery.plans.fixtures import Market

DATES = ("2021-03-17", "2021-05-31", "9999-12-31")
LABEL = {"d": lambda d: d, "w": lambda d: d - dt.timedelta(days=d.weekday()), "m": lambda d: (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)}


def random_rows(seed=3):
    rng = random.Random(seed)
    rows = [(s, dt.date(2021, 1, 1) + dt.timedelta(days=i), round(rng.uniform(1, 9), 3)) for s in "abcd" for i in range(200) if rng.random() < 0.4]
    return [r for r in rows if r[0] != "d" or r[1] > dt.date(2021, 3, 20)] + [("a", dt.date(2021, 8, 1), None)]


def expected(rows, freqs, date):
    """Rows of every series as of a date, each worked out by itself."""
    found = []
    for f in freqs:
        for s in sorted({r[0] for r in rows}):
            ends = {LABEL[f](d): x for _, d, x in sorted((r for r in rows if r[0] == s and r[2] is not None), key=lambda r: r[1]) if d.isoformat() <= date and (f != "d" or d.weekday() < 5)}
            labels = list(ends)
            found += [(f, s, d, ends[d], labels[i - 1] if i else None, ends[labels[i - 1]] if i else None, len(labels)) for i, d in enumerate(labels)]
    return found


def test_series_as_of_several_dates(spark):
    rows = random_rows()
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = B.close_series(bars, ("d", "w", "m"), DATES)
    want = sorted((dt.date.fromisoformat(d), *r) for d in DATES for r in expected(rows, "dwm", d))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    plain = [tuple(r) for r in B.close_series(bars, ("w",)).collect()]
    assert sorted(plain) == sorted(expected(rows, "w", DATES[-1]))


def test_series_of_trades_need_one_shuffle(spark):
    """However many frequencies and dates there are, trades are shuffled once, by stock."""
    m = Market(spark, "/root/testdata/sf0.001")
    series = B.close_series(m.closes, ("d", "w", "m"), ("1998-06-30", "9999-12-31"))
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    bars = Market(spark, "/root/testdata/sf0.001").all_bars
    columns = ["as_of", "freq", "symbol", "date", "close", "before", "old", "rows"]
    assert sorted(map(tuple, series.select(columns).collect()), key=str) == sorted(map(tuple, B.close_series(bars, ("d", "w", "m"), ("1998-06-30", "9999-12-31")).select(columns).collect()), key=str)


def test_closes_of_all_frequencies_are_not_sorted_again(spark):
    """Constituents' closes come in order of their stocks; the join with industries takes them as they come, whatever its size."""
    m = Market(spark, "/root/testdata/sf0.001", shared=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        closes = synthetic_index.member_closes(B.close_series(m.closes, ("d", "w", "m")), m.membership)
        plan = closes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    after = plan[: plan.index("Generate explode")]
    assert "Join" in after and "Sort" not in after


def test_sums_do_not_grow_with_constituents(spark):
    """Constituents with the same dates share the rows that are written out."""
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(30)]
    written = []

    def keep(frame):
        written.append(frame.count())
        return frame

    for n in (4, 40):
        bars = spark.createDataFrame([(f"s{s}", d, 10.0 + (s * 7 + i) % 5) for s in range(n) for i, d in enumerate(days)], "symbol string, date date, close double")
        members = spark.createDataFrame([(f"s{s}", "x", float(s)) for s in range(n)], "symbol string, industry_key string, market_cap double")
        found = synthetic_index.synthetic_index(bars, members, keep=keep).where(F.col("date") == days[1]).first()
        r = sum(s / sum(range(n)) * ((10 + (s * 7 + 1) % 5) / (10 + s * 7 % 5) - 1) for s in range(n))
        assert abs(found.close - 1000 * (1 + r)) < 1e-9 and found.members == n
    assert written == [30, 30]
