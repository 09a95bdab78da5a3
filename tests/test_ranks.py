"""Ranks by blocks against pandas: ties across borders, nulls, keys, and plans without a window over all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import ranks

KINDS = "k string, i int, v double"


def table(seed: int, rows: int, values: int, keys=("a", "b", None)) -> pd.DataFrame:
    """A third of the rows holds one value, some hold none; keys differ in size, one is null."""
    rng = np.random.default_rng(seed)
    v = rng.integers(0, values, rows).astype(float)
    v[rng.random(rows) < 0.34] = values // 2
    v[rng.random(rows) < 0.1] = np.nan
    k = rng.choice(len(keys), rows, p=[0.7, 0.2, 0.1])
    return pd.DataFrame({"k": [keys[j] for j in k], "i": np.arange(rows), "v": v})


def spark_rows(spark, frame: pd.DataFrame):
    return spark.createDataFrame([(k, int(i), None if np.isnan(v) else float(v)) for k, i, v in frame.itertuples(index=False)], KINDS)


@pytest.mark.parametrize("values", [3, 40, 10_000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scales_match_pandas(spark, values, keys):
    frame = table(values, 600, values)
    groups = frame.groupby("k", dropna=False)["v"] if keys else frame["v"]
    frame["share"] = groups.rank(pct=True)
    frame["least"] = groups.rank(method="min", ascending=False)
    rows = ranks.with_share(spark_rows(spark, frame[["k", "i", "v"]]), "share", "v", "i", keys=keys, blocks=7)
    rows = ranks.with_min_rank(rows, "least", "v", "i", keys=keys, blocks=5)
    got = rows.toPandas().sort_values("i")
    assert len(got) == len(frame) and list(got.columns) == ["k", "i", "v", "share", "least"]
    assert np.allclose(got["share"].astype(float), frame["share"], equal_nan=True, rtol=1e-15)
    assert np.allclose(got["least"].astype(float), frame["least"], equal_nan=True)


def test_one_value_spans_blocks(spark):
    """Borders cross the ties: more blocks than one hold the value, and all its rows stand alike."""
    rows = spark.createDataFrame([("a", i, 1.0 if i < 300 else 0.0 if i < 310 else 2.0) for i in range(320)], KINDS)
    blocks = ranks._blocks(rows, [F.col("v"), F.col("i")], 8).where("v = 1").select("_block").distinct().count()
    assert blocks >= 6
    got = ranks.with_standing(rows, "v", "i", blocks=8).groupBy("v").agg(F.collect_set(F.struct("_below", "_ties", "_known")).alias("s")).collect()
    assert {r.v: [tuple(x) for x in r.s] for r in got} == {0.0: [(0, 10, 320)], 1.0: [(10, 300, 320)], 2.0: [(310, 10, 320)]}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions_match_pandas(spark, keys):
    frame = table(9, 500, 5)
    ordered = frame.sort_values(["v", "i"], ascending=[False, True], na_position="last")
    want = (ordered.groupby("k", dropna=False).cumcount() if keys else pd.Series(range(len(ordered)), ordered.index)).sort_index() + 1
    got = ranks.with_position(spark_rows(spark, frame), "n", F.col("v").desc_nulls_last(), F.col("i"), keys=keys, blocks=6).toPandas().sort_values("i")
    assert got["n"].tolist() == want.tolist()


def test_empty_and_null_tables(spark):
    for rows in (spark.createDataFrame([], KINDS), spark.createDataFrame([("a", i, None) for i in range(5)], KINDS)):
        n = rows.count()
        assert [r.p for r in ranks.with_percentile(rows, "p", "v", "i").collect()] == [None] * n
        assert sorted(r.n for r in ranks.with_position(rows, "n", F.col("v"), F.col("i")).collect()) == list(range(1, n + 1))


def test_windows_have_the_block_as_key(spark):
    """Rows are ranked by block; windows over a whole key see one row a block only."""
    rows = ranks.with_percentile(spark_rows(spark, table(1, 200, 20)), "p", "v", "i", blocks=4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line or "_size" in line for line in windows)
