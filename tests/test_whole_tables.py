"""Registered queries and tests that have to cover their whole table."""

import os

import numpy as np
import pandas as pd
import pytest

from evidenta.operators import resampling as R
from evidenta.plans import insight_queries as Q


def customers(n, slope=0.0):
    rng = np.random.default_rng(5)
    nation = rng.integers(0, 25, n)
    balance = rng.normal(size=n).round(2) + slope * nation * np.where(np.arange(n) < 1500, -1, 1)
    return pd.DataFrame({"c_custkey": np.arange(1, n + 1), "c_nationkey": nation, "c_acctbal": balance})


def test_perm_fast_covers_every_customer(spark, tmp_path):
    """The first 1,500 customers fall with the nation's number, the others rise."""
    rows = customers(9000, 0.2)
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "customer.parquet"))
    got = Q.perm_fast(spark, str(tmp_path)).first()
    assert abs(got["statistic"] - rows["c_nationkey"].rank().corr(rows["c_acctbal"].rank())) < 1e-9
    assert got["statistic"] > 0.3 and got["resamples"] == 10_000 and got["p_value"] == 1 / 10_001


def test_spread_rank_test_agrees_with_the_short_one_on_any_partitioning(spark):
    rows = customers(9000)
    rows["c_acctbal"] += 0.002 * rows["c_nationkey"]
    df = spark.createDataFrame(rows)
    one = R.spread_rank_test(df.repartition(5), "c_nationkey", "c_acctbal", "c_custkey", 2000).first()
    two = R.spread_rank_test(df.coalesce(1), "c_nationkey", "c_acctbal", "c_custkey", 2000).first()
    short = R.fast_rank_test(df, "c_nationkey", "c_acctbal", 2000).first()
    assert one == two and abs(one["statistic"] - short["statistic"]) < 1e-6
    assert 0.02 < short["p_value"] < 0.98 and abs(one["p_value"] - short["p_value"]) < 0.06


def test_blocks_share_every_level_out():
    levels, sizes = np.array([5, 40, 300]), np.array([100, 0, 145, 60, 40])
    for b in range(20):
        parts = [R._dealt(levels, sizes, k, 7, b) for k in range(5)]
        assert [p.sum() for p in parts] == list(sizes) and (sum(parts) == levels).all()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_only_an_incomplete_last_month_goes(spark, monkeypatch):
    """July 2001 is whole and stays; August 2001 is a stub and goes; a later whole month would stay."""
    from evidenta.plans import views

    series = views.month_series(spark, SF).toPandas().sort_values("month_no")
    assert series["month"].iloc[-2:].tolist() == ["2001-07", "2001-08"]
    panel = views.region_month(spark, SF)
    got = {r["month"] for r in views.whole_months(panel, spark, SF).select("month").distinct().collect()}
    assert got == {r["month"] for r in panel.select("month").distinct().collect()} - {"2001-08"}
    seen = {}
    monkeypatch.setattr(Q.T, "backtests", lambda df, *a: seen.setdefault("last", df.agg({"month_no": "max"})))
    monkeypatch.setattr(Q, "rounded", lambda df, n: df)
    assert Q.forecast_backtest(spark, SF).first()[0] == 2001 * 12 + 6
    whole = series[series["month"] < "2001-08"]
    monkeypatch.setattr(views, "month_series", lambda *a: spark.createDataFrame(whole))
    assert {r["month"] for r in views.whole_months(panel, spark, SF).select("month").distinct().collect()} >= {"2001-07", "2001-08"}
