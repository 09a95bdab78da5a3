"""Windows and leaders where the tables hold no correction, and where closes are flat."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from orrery.operators import leaders
from orrery.plans import registry


def test_window_without_correction_is_the_same_in_sql(spark, tmp_path):
    days = [dt.datetime(1998, 1, 5) + dt.timedelta(days=i) for i in range(60)]
    rows = [(i, 1, 1, 1, 5.0, 1000.0, d) for i, d in enumerate(days)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    items.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in registry.QUERIES["drawdown_window"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == con.execute(registry.SQL["drawdown_window"]).fetchall() == [(dt.date(1998, 1, 31), dt.date(1998, 3, 2))]


def test_flat_closes_are_not_above_their_mean(spark):
    days = [dt.date(2001, 8, 1) + dt.timedelta(days=i) for i in range(40)]
    price = {"a": 105.52, "b": 109.68, "c": 102.13, "d": 102.27, "e": 90.07, "f": 99.99}
    bars = spark.createDataFrame([(s, d, p, p + 1, p - 1, p, 10.0) for s, p in price.items() for d in days], "symbol string, date date, open double, high double, low double, close double, volume double")
    benchmark = spark.createDataFrame([(d, 100.0) for d in days], "date date, close double")
    window = spark.createDataFrame([(days[20], days[-1])], "start date, end date")
    members = spark.createDataFrame([(s, "1") for s in price], "symbol string, industry_key string")
    dim = spark.createDataFrame([("1", "s", "1", "i", "^1")], "sector_key string, sector_name string, industry_key string, industry_name string, symbol string")
    momentum = dim.select("industry_key", F.lit("BUY").alias("faber_signal"))
    found = leaders.closing_range_leaders(bars, benchmark, window, members, momentum, dim, min_score=0, min_days=2).collect()
    assert len(found) == 6 and {r.ema21_held_pct for r in found} == {0.0}
