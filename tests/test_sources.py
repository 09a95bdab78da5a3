"""Readers on files as they come: missing and reordered columns, repeated dates, spellings of share classes, other files."""

import datetime as dt

import pytest

from orrery.operators import clock
from orrery.sources import readers, sinks

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def day(n):
    return dt.date(2024, 5, n)


def bar(symbol, n, close):
    return symbol, day(n), close, close + 1, close - 1, close, 10.0


def test_bar_files_with_other_columns(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume,marketCap\n2024-05-06 00:00:00-04:00,1,2,0.5,1.5,10,99\n2024-05-07,1,2,0.5,,10,\n2024-05-11,1,1,1,1,1,1\n")
    (tmp_path / "B%2FC.csv").write_text("Date,Close,Volume,Open\r\n2024-05-06,7,x,3\r\nnonsense,1,1,1\r\n\r\n")
    (tmp_path / "BAD.csv").write_text("When,Price\n2024-05-06,1\n")
    got = {(r.symbol, r.date): r for r in readers.bar_files(spark, str(tmp_path)).collect()}
    assert set(got) == {("A", day(6)), ("A", day(7)), ("B/C", day(6))}  # the Saturday, the undated row and the odd file are out
    a, b = got["A", day(6)], got["B/C", day(6)]
    assert (a.open, a.close, a.market_cap) == (1.0, 1.5, 99.0) and got["A", day(7)].close is None
    assert (b.open, b.high, b.close, b.volume, b.market_cap) == (3.0, None, 7.0, None, None)
    assert readers.bar_files(spark, str(tmp_path), weekdays_only=False).count() == 4
    caps = {r.symbol: r.market_cap for r in readers.latest_caps(readers.bar_files(spark, str(tmp_path))).collect()}
    assert caps == {"A": 99.0}


def test_quoted_values_and_headers_of_three_kinds(spark, tmp_path):
    (tmp_path / "A.csv").write_text('"Date","Note","Close","Volume"\n2024-05-06,"a, ""b"", c",1.5,"1,000"\n2024-05-07,plain,"2.5",7\n')
    (tmp_path / "B [1]*.csv").write_text("\ufeffClose,Date\r\n3,2024-05-06\r\n")
    (tmp_path / "C.csv").write_text("Date,Close,Close,High\n2024-05-06,4,9\n2024-05-07,5,9,6,extra\n")
    (tmp_path / "EMPTY.csv").write_text("")
    got = {(r.symbol, r.date.day): (r.close, r.high, r.volume) for r in readers.bar_files(spark, str(tmp_path)).collect()}
    # a number with a comma is no number, and takes no other column with it
    assert got == {("A", 6): (1.5, None, None), ("A", 7): (2.5, None, 7.0), ("B [1]*", 6): (3.0, None, None), ("C", 6): (4.0, None, None), ("C", 7): (5.0, 6.0, None)}


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=i) for i in range(6000)]
    (tmp_path / "A.csv").write_text("Date,Close\n" + "".join(f"{d},{i}\n" for i, d in enumerate(days)) + f"{days[-1]},7\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        bars = readers.bar_files(spark, str(tmp_path), weekdays_only=False)
        assert bars.rdd.getNumPartitions() >= 4 and bars.count() == 6001
        got = {r.date: r.close for r in readers.closes(bars).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 6000 and got[days[10]] == 10.0 and got[days[-1]] == 7.0
    plan = bars.select("close")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan


def test_closes_keep_the_last(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Close\n2024-05-06,9\n2024-05-06,5\n2024-05-07,3\n2024-05-07,\n")
    got = {r.date: r.close for r in readers.closes(readers.bar_files(spark, str(tmp_path))).collect()}
    assert got == {day(6): 5.0}  # the last row of the 7th has no close, and an older row does not come back


def test_batches_skip_bad_files(spark, tmp_path):
    (tmp_path / "prices_1d_2024-05-06.csv").write_text("Date,Symbol,Open,High,Low,Close,Volume\n2024-05-06,a,1,1,1,1,1\n")
    (tmp_path / "prices_1d_2024-05-07.csv").write_text("Volume,Close,Symbol,Low,High,Open,Date\n5,4, b ,3,2,1,2024-05-07\n5,4,b,3,2,1,2024-05-01\n")
    (tmp_path / "prices_1d_2024-05-08.csv").write_text("Date,Symbol,Close\n2024-05-08,c,1\n")
    (tmp_path / "notes_2024-05-09.csv").write_text("Date,Symbol,Open,High,Low,Close,Volume\n2024-05-09,d,1,1,1,1,1\n")
    everything = {(r.symbol, r.date) for r in readers.batch_files(spark, str(tmp_path)).collect()}
    assert everything == {("A", day(6)), ("B", day(7)), ("B", day(1))}
    newer = readers.batch_files(spark, str(tmp_path), "2024-05-06").collect()
    assert [(r.symbol, r.date, r.open, r.high, r.low, r.close, r.volume) for r in newer] == [("B", day(7), 1.0, 2.0, 3.0, 4.0, 5.0)]


def test_spellings_do_not_mix(spark):
    history = spark.createDataFrame([bar("BRK.B", 1, 10.0), bar("BRK-B", 1, 20.0), bar("X.Y", 1, 1.0), bar("^IX", 1, 1.0), bar("P-Q", 1, 1.0)], BAR)
    batch = spark.createDataFrame([bar("BRK.B", 2, 11.0), bar("BRK-B", 2, 22.0), bar("X-Y", 2, 3.0), bar("^IX", 2, 3.0), bar("P.Q", 2, 4.0), bar("NEW", 2, 4.0), bar("BRK.B", 1, 99.0)], BAR)
    got = sorted((r.symbol, r.date.day, r.close) for r in readers.stitch(history, batch).collect())
    assert got == [("BRK-B", 1, 20.0), ("BRK-B", 2, 22.0), ("BRK.B", 1, 10.0), ("BRK.B", 2, 11.0), ("P-Q", 1, 1.0), ("P-Q", 2, 4.0), ("X.Y", 1, 1.0), ("X.Y", 2, 3.0), ("^IX", 1, 1.0)]


def test_files_written_are_read_back(spark):
    bars = spark.createDataFrame([bar("A/B", 6, 10.0), bar("A/B", 7, 11.0), bar("C", 6, 3.0)], BAR)
    read = readers.bar_files(spark, sinks.write_bar_files(bars)).select(*bars.columns)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, bars.collect()))


def test_universe_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("symbol,group_name,market_cap\nA,large,5\nB,micro,1\nC,mid,x\n")
    got = {(r.ticker, r.market_cap) for r in readers.universe_listed(spark, str(tmp_path)).collect()}
    assert got == {("A", 5.0), ("C", None)}
    assert readers.universe("file", file=lambda: 3) == 3
    with pytest.raises(ValueError, match="unknown universe"):
        readers.universe("web", file=lambda: 3)


def test_snapshot_choice(spark):
    table = spark.createDataFrame([(1, day(1)), (2, day(3)), (3, day(5))], "x int, as_of date")
    pick = lambda **k: [r.x for r in readers.snapshot(table, **k).collect()]
    assert (pick(), pick(upto="2024-05-04"), pick(upto="2024-05-03", exact=True), pick(upto="2024-05-04", exact=True), pick(before="2024-05-03")) == ([3], [2], [2], [], [1])


def test_volume_after_none_counts_as_more():
    c = clock.Clock(state=clock.UPTREND, last_close=100.0, last_volume=0.0)
    assert c.bar("d", 98.0, 99.0, 5.0, clock.Limits())["event"] == "Distribution"
    c = clock.Clock(state=clock.UPTREND, last_close=100.0, last_volume=0.0)
    assert c.bar("d", 98.0, 99.0, 0.0, clock.Limits())["event"] is None


def test_universe_from_a_database(spark):
    url, driver = "jdbc:derby:memory:test;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(f"T{i}", ("large", "mid", "small", "micro")[i % 4], float(i) if i != 7 else None) for i in range(40)]
    sinks.write_universe_jdbc(spark.createDataFrame(rows, "ticker string, group_name string, market_cap double"), url, "u", driver=driver)
    found = readers.universe_jdbc(spark, url, "u", ("large", "micro"), partitions=4, driver=driver)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((r for r in rows if r[1] in ("large", "micro")), key=str)
    assert found.rdd.getNumPartitions() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*In(group_name" in plan
    assert readers.universe_jdbc(spark, url, "u", ("none",), partitions=4, driver=driver).count() == 0
