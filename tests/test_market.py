"""Operators on random bars against pandas, and batch against stream."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import bars as B
from orrery.operators import clock, delta, leaders, strength, synthetic_index
from orrery.plans.fixtures import Market
from orrery.sources import readers, sinks
from orrery.streaming import clock_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def random_bars(spark):
    rng, rows, start = np.random.default_rng(5), [], dt.date(2023, 1, 2)
    for s in "abcde":
        price = 50.0
        for i in range(330):
            price *= 1 + rng.normal(0, 0.02)
            if rng.random() < 0.15 or (s == "e" and 100 < i < 112):
                continue
            rows.append((s, start + dt.timedelta(days=i), price, price * 1.01, price * 0.98, price, float(rng.integers(100, 999))))
    return pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume"])


def test_synthetic_index_matches_pandas(spark, random_bars):
    caps = {"a": 10.0, "b": 30.0, "c": 60.0, "d": None, "e": 100.0}
    members = spark.createDataFrame([(s, "x", c) for s, c in caps.items()] + [("a", "small", 1.0), ("b", "small", 1.0)], "symbol string, industry_key string, market_cap double")
    got = synthetic_index.synthetic_index(spark.createDataFrame(random_bars), members, fill=5).toPandas().sort_values("date")
    assert set(got.industry_key) == {"x"}  # two constituents are too few
    wide = random_bars.pivot(index="date", columns="symbol", values="close").sort_index().ffill(limit=5)
    w = pd.Series({s: (c or 0.0) for s, c in caps.items()})
    ret = (wide.pct_change(fill_method=None) * (w / w.sum())).sum(axis=1)
    want = (1 + ret).cumprod() * 1000
    want = want[want.index >= got.date.min()]
    assert np.allclose(got.close.to_numpy(), want.to_numpy(), rtol=1e-9)


def test_results_do_not_see_later_rows(spark, random_bars):
    members = spark.createDataFrame([(s, "x", 1.0) for s in "abcde"], "symbol string, industry_key string, market_cap double")
    frame = spark.createDataFrame(random_bars)
    whole = synthetic_index.synthetic_index(frame, members).where("date <= '2023-06-30'")
    cut = synthetic_index.synthetic_index(B.as_of(frame, "2023-06-30"), members)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_gap_filling_stops(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 if i == 0 else None) for i in range(8)]
    got = spark.createDataFrame(rows, "symbol string, date date, close double").select("date", B.filled(F.col("close"), ["symbol"], 5).alias("c")).orderBy("date").collect()
    assert [r.c for r in got] == [1.0] * 6 + [None] * 2


def test_month_of_file_and_newer_days_is_one_row(spark):
    stored = spark.createDataFrame([("a", dt.date(2024, 5, 1), 1.0, 2.0, 0.5, 1.5, 10.0), ("a", dt.date(2024, 6, 1), 1.0, 2.0, 0.5, 1.7, 10.0)], "symbol string, date date, open double, high double, low double, close double, volume double")
    daily = spark.createDataFrame([("a", dt.date(2024, 6, 20), 3.0, 3.0, 3.0, 3.0, 1.0)], stored.schema)
    got = B.merge_monthly(stored, daily).orderBy("date").collect()
    assert [(r.date, r.close) for r in got] == [(dt.date(2024, 5, 31), 1.5), (dt.date(2024, 6, 30), 3.0)]


def clock_path():
    """Closes and volumes that pass through every state."""
    close, volume = [100.0], [100.0]

    def day(pct, vol):
        close.append(close[-1] * (1 + pct / 100))
        volume.append(float(vol))

    for pct, vol in [(-1, 90), (1, 80), (-3, 120), (0.5, 80), (0.4, 90), (0.3, 95), (1.6, 150)] + [(-0.5, 160 + i) for i in range(5)] + [(0.1, 100), (0.2, 170), (-9, 180), (1, 90)]:
        day(pct, vol)
    return [("X", dt.date(2024, 1, 1) + dt.timedelta(days=i), c * 0.999, c, v) for i, (c, v) in enumerate(zip(close, volume, strict=True))]


def test_clock_states_and_stream(spark):
    bars = spark.createDataFrame(clock_path(), "symbol string, date date, low double, close double, volume double")
    traced = clock.trace(bars).orderBy("date").collect()
    states = [r.state for r in traced]
    assert states[2] == clock.RALLY and states[3] == clock.CORRECTION and states[7] == clock.UPTREND and traced[7].event == "Follow-Through" and traced[7].event_day == 4
    assert clock.PRESSURE in states and clock.STRESS in states and states[-2] == clock.CORRECTION and states[-1] == clock.RALLY
    assert [r.event for r in traced].count("Distribution") == 6 and [r.event for r in traced].count("Stall") == 1
    ends = clock.market_clock(bars, min_rows=5).first()
    assert ends.state == "Rally Attempt 1" and ends.last_ftd_day == 4
    # two micro-batches, the second of which repeats a late bar, with the stream started again in between
    path, out = sinks.shared_path(spark, "bars"), sinks.shared_path(spark, "clock")
    for part in (bars.where("date <= '2024-01-09'"), bars.where("date >= '2024-01-09'")):
        part.write.mode("append").parquet(path)
        clock_stream.start(clock_stream.clock_states(spark.readStream.schema(bars.schema).parquet(path)), out, f"{out}-c").awaitTermination()
    streamed = spark.read.parquet(out).orderBy("date").collect()
    assert [(r.date, r.state, r.event, r.dd_count) for r in streamed] == [(r.date, r.state, r.event, r.dd_count) for r in traced]


def test_clock_stream_starts_from_a_history(spark):
    rows = clock_path() + [("Y", d, low, c, v) for _, d, low, c, v in clock_path()[:4]]
    bars = spark.createDataFrame(rows, "symbol string, date date, low double, close double, volume double")
    traced = {(r.symbol, r.date): r for r in clock.trace(bars).collect()}
    got = clock_stream.replay(bars, ("2024-01-10", "2024-01-14")).collect()
    assert {(r.symbol, r.date): r for r in got} == traced and len(got) == len(traced)
    # an index that the history lacks starts anew
    fresh = clock_stream.replay(bars.where("symbol = 'X' or date >= '2024-01-03'"), ("2024-01-03", "2024-01-14")).where("symbol = 'Y'").orderBy("date").first()
    assert fresh.state == clock.CORRECTION and fresh.pct_chg is None


def test_ath_labels(spark):
    def index(key, closes):
        return [(key, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c), 3) for i, c in enumerate(closes)]

    up = list(np.linspace(100, 200, 240))
    rows = index("new", up) + index("near", up + [197] * 150) + index("below", up + [100] * 160)
    frame = spark.createDataFrame(rows, "industry_key string, date date, close double, members int")
    dim = spark.createDataFrame([], "industry_key string, sector_key string, sector_name string, industry_name string")
    got = {r.industry_key: r for r in strength.ath_monitor(frame, dim).collect()}
    assert got["new"].ath_signal == "New ATH" and got["new"].months_since_ath == 0
    assert got["near"].ath_signal == "Near ATH" and got["near"].ath_score == 70.0
    assert got["below"].ath_signal == "Below ATH" and got["below"].industry_name == "below"


def test_windows_of_corrections(spark):
    closes = [100, 94, 93, 99, 101, 95, 94, 100, 102]
    b = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)], "date date, close double")
    assert tuple(leaders.drawdown_window(b).first()) == (dt.date(2024, 1, 6), dt.date(2024, 1, 9))
    assert tuple(leaders.drawdown_window(b, depth=20.0).first()) == (dt.date(2023, 12, 10), dt.date(2024, 1, 9))
    assert leaders.peak_window(b).count() == 0
    assert tuple(leaders.peak_window(b.where("date <= '2024-01-07'")).first()) == (dt.date(2024, 1, 6), dt.date(2024, 1, 7))


def test_delta_flags(spark):
    schema = "industry_key string, industry_name string, sector_name string, severity_label string, faber_signal string, stage string, quadrant string, quadrant_m string, ath_signal string, severity_score double, minervini_count int, rs_pct_composite int, rs_pct_3m int, sctr double"

    def row(key, label="Confirmed", faber="BUY", stage="2B", score=60.0, n=5, rs=70):
        return (key, key, "s", label, faber, stage, "Leading", "Leading", "Near ATH", score, n, rs, rs, 50.0)

    now = spark.createDataFrame([row("same"), row("new"), row("up", "Strong Confirmed ★RS", "STRONG BUY", score=64.0, n=7, rs=80)], schema)
    before = spark.createDataFrame([row("same"), row("gone"), row("up")], schema)
    got = {r.industry_key: r for r in delta.compare(now, before).collect()}
    assert got["new"].is_new and got["gone"].is_dropped and not got["same"].any_change
    assert got["up"].sev_rank_delta == 2 and got["up"].severity_score_delta == 4.0 and got["up"].any_change
    line = delta.compare(now, before).where("industry_key = 'up'").select(delta.narrative().alias("n")).first().n
    assert line == "Severity: Confirmed → Strong Confirmed ★RS  |  Faber: BUY → STRONG BUY  |  RS: 70→80 (+10)  |  Minervini: 5→7/7 (+2)"
    assert {r.crossing for r in delta.crossings(delta.compare(now, before)).collect()} == {"new STRONG BUY"}


def test_bar_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume,marketCap\n2024-01-05 00:00:00-05:00,1,2,0.5,1.5,10,5e9\n2024-01-06,1,2,0.5,1.6,10,\nbad,1,1,1,1,1,1\n2024-01-08,1,2,0.5,1.7,NaN,6e9\n")
    got = readers.bar_files(spark, str(tmp_path / "d")).orderBy("date").collect()
    assert [(r.symbol, str(r.date), r.close, r.volume) for r in got] == [("AAA", "2024-01-05", 1.5, 10.0), ("AAA", "2024-01-08", 1.7, None)]
    assert readers.latest_caps(readers.bar_files(spark, str(tmp_path / "d"))).first().market_cap == 6e9
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "prices_1d_2024-01-09.csv").write_text("Date,Symbol,Open,High,Low,Close,Volume\n2024-01-09,aaa,1,1,1,2.0,1\n2024-01-02,aaa,1,1,1,9.0,1\n2024-01-09,zzz,1,1,1,2.0,1\n")
    (tmp_path / "b" / "prices_1d_2024-01-03.csv").write_text("Date,Symbol,Open,High,Low,Close,Volume\n2024-01-10,aaa,1,1,1,3.0,1\n")
    batch = readers.batch_files(spark, str(tmp_path / "b"), "2024-01-08")
    history = readers.bar_files(spark, str(tmp_path / "d")).drop("market_cap")
    both = readers.stitch(history, batch).orderBy("date").collect()
    assert [(r.symbol, str(r.date)) for r in both] == [("AAA", "2024-01-05"), ("AAA", "2024-01-08"), ("AAA", "2024-01-09")]
    with pytest.raises(ValueError):
        readers.universe("none", sc=lambda: None)


def test_snapshots_replace_their_own_date(spark, tmp_path):
    path = str(tmp_path / "t")
    for day, v in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 3)):
        sinks.write_snapshot(spark.createDataFrame([(v,)], "v int"), path, day)
    table = spark.read.parquet(path)
    assert {(str(r.as_of), r.v) for r in table.collect()} == {("2024-01-01", 3), ("2024-01-02", 2)}
    assert readers.snapshot(table).first().v == 2 and readers.snapshot(table, before="2024-01-02").first().v == 3


def test_entry_and_a_table_of_each_kind(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len([k for k in q if not k.startswith("op")]) > 60
    m = Market(spark, SF)
    assert m.bars.where(F.weekday("date") >= 5).count() == 0
