"""No plan orders rows in one task: windows without a partition run over bounded tables only, and cuts are exact."""

from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidenta.functions.quantiles import exact_quantile, running_total
from evidenta.functions.scalars import seeded
from evidenta.operators import attacks as K
from evidenta.operators import gateway as G
from evidenta.operators import resampling as R


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("values", ["ties", "spread", "one", "few"])
def test_quantiles_equal_numpy(spark, values, q):
    rng = np.random.default_rng(1)
    x = {"ties": rng.integers(0, 4, 3000).astype(float), "spread": rng.lognormal(0, 4, 3000), "one": np.full(50, 2.5), "few": np.array([3.0, 1.0])}[values]
    df = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(x)], "v double, g string").repartition(5)
    assert exact_quantile(df, "v", q).first()["quantile"] == pytest.approx(np.quantile(x, q))
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"]).collect()}
    assert got == {g: pytest.approx(np.quantile(x[i::2], q)) for i, g in enumerate("ab")}


def test_running_totals_equal_a_sort(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(np.round(rng.normal(size=3000), 3))
    df = spark.createDataFrame([(float(k), int(i % 5 + 1)) for i, k in enumerate(keys)], "k double, m long").repartition(4)
    got = sorted((r["k"], r["upto"]) for r in running_total(df, "k", "m").collect())
    assert [u for _, u in got] == np.cumsum([i % 5 + 1 for i in range(len(keys))]).tolist()
    assert running_total(df.limit(0), "k", "m").count() == 0


@pytest.mark.parametrize("n", [0, 1, 37, 500, 1000])
def test_least_draws_are_those_of_a_sort(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "rid")
    got = {r["rid"] for r in G.least_draws(df, seeded(7, F.col("rid")), "rid", n, "m").where("m").collect()}
    assert got == {r["rid"] for r in df.orderBy(seeded(7, F.col("rid")), "rid").limit(n).collect()}


def test_trim_takes_the_most_extreme_tenth(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), float(i % 7)) for i, v in enumerate(np.concatenate([rng.normal(size=160), np.repeat([50.0, -60.0, 70.0], 20)]))]
    df = spark.createDataFrame(rows, "rid int, x double, y double")
    scored = sorted(((-r["extremity"], r["rid"]) for r in K.robust_scores(df, ["x"]).collect()))
    gone = {i for _, i in scored[:22]}
    expected = K.correlation_effect("x", "y")(df.where(~F.col("rid").isin(gone))).first()
    row = K.trim(df, K.correlation_effect("x", "y"), ["x"], "rid").first()
    assert (row["rows"], row["attacked"]) == (198, pytest.approx(expected["effect"]))


def test_large_tables_are_refused_not_cut(spark, monkeypatch):
    df = spark.range(50).selectExpr("id as rid", "id * 1.0 as x", "id * 2.0 as y")
    monkeypatch.setattr(R, "FAST_ROWS", 10)
    monkeypatch.setattr(R, "PLACED_ROWS", 10)
    with pytest.raises(ValueError, match="spread_rank_test"):
        R.fast_rank_test(df, "x", "y", 99)
    with pytest.raises(ValueError, match="spread_rank_test"):
        R.correlation_test(df, "x", "y", "rid", 9)
    assert R.spread_rank_test(df, "x", "y", "rid", 99).first()["p_value"] == pytest.approx(0.01)


def test_sales_joins_only_what_its_columns_need(spark):
    import os

    from evidenta.plans.views import sales, table

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    files = lambda df: {f.rsplit("/", 1)[1].split(".")[0] for f in df.inputFiles()}
    assert files(sales(spark, sf, "revenue")) == {"lineitem"}
    assert files(sales(spark, sf, "cost", "month_no")) == {"lineitem", "part", "orders"}
    assert sales(spark, sf).count() == table(spark, sf, "lineitem").count() == sales(spark, sf, "nation").count()


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("kind", ["free", "stratified", "groups", "unpaired"])
def test_resamples_do_not_reach_the_driver(spark, small_broadcasts, kind):
    """3,000 rows fit into a broadcast of 40 MB, their 999 resamples do not; the figures are those of a plain version."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"rid": np.arange(3000), "s": rng.integers(0, 3, 3000), "x": rng.integers(0, 25, 3000), "y": rng.normal(size=3000).round(2)})
    if kind == "unpaired":
        rows["s"] = 1 + rows["s"] % 2
    df = spark.createDataFrame(rows).repartition(3)
    test, label = {
        "free": (lambda: R.correlation_test(df, "x", "y", "rid", 999, 7), None),
        "stratified": (lambda: R.correlation_test(df, "x", "y", "rid", 999, 7, "s"), "s"),
        "groups": (lambda: R.group_test(df, "s", "y", "1", "rid", 999, 7), None),
        "unpaired": (lambda: R.unpaired_change_test(df, "y", "s", "rid", 999, 7), None),
    }[kind]
    got = test().first()
    moves = {"groups": rows["s"] == 1, "unpaired": rows["s"] == 2}.get(kind, rows["y"].rank()).to_numpy(float)
    waits = {"free": rows["x"].rank(), "stratified": rows["x"].rank(), "groups": rows["y"].rank(), "unpaired": rows["y"]}[kind].to_numpy(float)
    strata = rows[label].to_numpy() if label else np.zeros(len(rows), dtype=int)
    rid, na, n = rows["rid"].to_numpy(), moves.sum(), len(rows)

    def statistic(m):
        if kind == "groups":
            return 2 * (m @ waits - na * (na + 1) / 2) / (na * (n - na)) - 1
        if kind == "unpaired":
            rest = (waits.sum() - m @ waits) / (n - na)
            return (m @ waits / na - rest) / abs(rest)
        return np.corrcoef(m, waits)[0, 1]

    def drawn(b):
        m = np.empty(n)
        for s in np.unique(strata):
            at = np.flatnonzero(strata == s)
            m[at] = moves[sorted(at, key=lambda k: md5(f"7:{b}:{rid[k]}".encode()).digest())]
        return m

    seen = statistic(moves)
    assert got["statistic"] == pytest.approx(seen, abs=1e-9)
    assert got["extreme"] == sum(abs(statistic(drawn(b))) >= abs(seen) - 1e-12 for b in range(999))
