"""Distributions, effect sizes, resampling, the gate and series tests."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidenta.functions import distributions as D
from evidenta.functions.quantiles import exact_quantile
from evidenta.operators import association as A
from evidenta.operators import attacks as K
from evidenta.operators import gateway as G
from evidenta.operators import resampling as R
from evidenta.operators import series as T


def test_distributions_against_tables():
    assert D.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert D.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-5)
    assert D.f_sf(3.4903, 3, 12) == pytest.approx(0.05, abs=1e-5)
    assert D.chi2_sf(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert D.noncentral_f_sf(3.0, 2, 20, 1e-9) == pytest.approx(D.f_sf(3.0, 2, 20), abs=1e-8)
    rng = np.random.default_rng(1)
    ratio = (rng.noncentral_chisquare(2, 5.0, 200_000) / 2) / (rng.chisquare(20, 200_000) / 20)
    assert D.noncentral_f_sf(3.0, 2, 20, 5.0) == pytest.approx((ratio > 3.0).mean(), abs=0.005)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_equals_numpy(spark, q):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": np.round(rng.lognormal(size=5000), 2)})
    frame.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None)))
    out = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"]).collect()}
    for g, part in frame.groupby("g"):
        assert out[g] == pytest.approx(part["v"].quantile(q))


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(20260903)
    n = 240
    age = rng.normal(45, 14, n)
    bmi = 18 + 0.16 * age + rng.normal(0, 4, n)
    area = rng.choice(["urban", "rural"], n, p=[0.55, 0.45])
    income = rng.lognormal(10, 0.55, n) * np.where(area == "urban", 1.9, 1.0)
    month = rng.integers(1, 13, n)
    frame = pd.DataFrame({"row_id": range(n), "age": age, "bmi": bmi, "area": area, "income": income, "month": month, "visits": 2 + 0.3 * month + rng.normal(0, 2.2, n), "decoy": rng.permutation(bmi), "noise": rng.normal(size=n)})
    return spark.createDataFrame(frame), frame


def test_effects_equal_pandas(toy):
    df, f = toy
    assert A.pearson(df, "age", "bmi").first()["pearson_r"] == pytest.approx(f["age"].corr(f["bmi"]))
    assert A.spearman(df, "age", "bmi").first()["spearman_rho"] == pytest.approx(f["age"].rank().corr(f["bmi"].rank()))
    assert A.spearman(df, "month", "visits").first()["spearman_rho"] == pytest.approx(f["month"].rank().corr(f["visits"].rank()))
    a, b = f[f["area"] == "urban"]["income"].to_numpy(), f[f["area"] == "rural"]["income"].to_numpy()
    delta = np.sign(a[:, None] - b[None, :]).mean()
    assert A.cliffs_delta(df, "area", "income", "urban").first()["cliffs_delta"] == pytest.approx(delta)
    tau = A.kendall_tau_b(df, "month", "visits", "row_id").first()["tau_b"]
    x, y = f["month"].to_numpy(), f["visits"].to_numpy()
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert tau == pytest.approx((sx * sy).sum() / math.sqrt(np.abs(sx).sum() * np.abs(sy).sum()))


def test_constant_columns_have_no_effect(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(30)], "row_id int, c double, v double")
    assert A.pearson(df, "c", "v").first()["pearson_r"] == 0 and A.spearman(df, "c", "v").first()["spearman_rho"] == 0


def test_permutation_finds_effects_and_not_noise(toy):
    df, _ = toy
    true = R.correlation_test(df, "age", "bmi", "row_id", 199).first()
    null = R.correlation_test(df, "age", "decoy", "row_id", 199).first()
    group = R.group_test(df, "area", "income", "urban", "row_id", 199).first()
    assert true["p_value"] == 1 / 200 and group["p_value"] == 1 / 200 and null["p_value"] > 0.05
    again = R.correlation_test(df.repartition(7), "age", "decoy", "row_id", 199).first()
    assert again["p_value"] == null["p_value"]


def test_fast_path_agrees(toy):
    df, _ = toy
    fast = R.fast_rank_test(df, "age", "decoy", 2000).first()
    slow = R.correlation_test(df, "age", "decoy", "row_id", 400).first()
    assert fast["resamples"] == 2000 and fast["statistic"] == pytest.approx(slow["statistic"])
    assert abs(fast["p_value"] - slow["p_value"]) < 0.1
    assert R.fast_rank_test(df, "age", "bmi", 2000).first()["p_value"] == 1 / 2001


def test_stratified_labels_stay_in_their_stratum(spark):
    rows = [(i, i % 2, float(10 * (i % 2)) + (i % 5) / 10, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, period int, x double, y double")
    moved = R.shuffled(R.numbered(df, "row_id", ["period"]), 5, 1, "row_id", ["period"])
    per = moved.groupBy("b", "period").agg(F.count_distinct("j").alias("k"), F.max("j").alias("m")).collect()
    assert len(per) == 10 and all(r["k"] == r["m"] == 30 for r in per)


def test_bh_and_gate(spark):
    rows = [("a", 0.001, "spearman_rho", 0.4, "positive"), ("b", 0.001, "spearman_rho", 0.4, "negative"), ("c", 0.001, "spearman_rho", 0.05, None), ("d", 0.2, "spearman_rho", 0.4, None), ("e", None, "kendall_tau_b", 0.4, None), ("f", 0.001, "spearman_rho", float("nan"), None)]
    df = spark.createDataFrame(rows, "claim_id string, p_value double, metric string, effect double, direction string")
    out = {r["claim_id"]: r for r in G.decide(df).collect()}
    assert [out[k]["outcome"] for k in "abcdef"] == ["supported", "refuted", "negligible", "inconclusive", "inconclusive", "invalid"]
    assert [out[k]["verdict"] for k in "ab"] == ["PASS", "REJECT"] and 0 < out["a"]["evidence_score"] <= 1
    assert all(r["q_value"] >= r["p_value"] for r in out.values())
    assert G.invariant_violations(G.decide(df)).count() == 0
    assert {r["claim_id"] for r in G.memory_guard(G.decide(df)).collect()} == {"a"}


def test_gate_is_strict_at_alpha_and_inclusive_at_the_floor(spark):
    df = spark.createDataFrame([("a", 0.05, 0.05), ("b", 0.0499, 0.0499)], "claim_id string, p_value double, q_value double")
    df = df.selectExpr("*", "'spearman_rho' as metric", "0.1 as effect", "cast(null as string) as direction")
    out = {r["claim_id"]: r["outcome"] for r in G.evaluate(df).collect()}
    assert out == {"a": "inconclusive", "b": "supported"}


def test_plans(spark):
    rows = [(p, e, "x" if e < 4 else "y", float(p * e % 7), float(p + e)) for p in range(24) for e in range(8)]
    panel = spark.createDataFrame(rows, "p int, e int, side string, v double, w double")
    assert G.assign_plan(panel, "correlation", "v", "w", "cross_section").scheme == "free"
    assert G.assign_plan(panel, "correlation", "v", "w", "panel", "p", "p", "e").scheme == "stratified"
    assert G.assign_plan(panel, "group_difference", "side", "v", "panel", "p", "p", "e").scheme == "cluster"
    assert G.assign_plan(panel, "period_change", "p", "v", "panel", "p", "p", "e").scheme == "paired"
    assert G.assign_plan(panel, "trend", "v", "w", "panel", "p", "p", "e").scheme is None
    assert G.assign_plan(panel.where("p < 10"), "trend", "p", "w", "panel", "p", "p", "e").reason.startswith("10 periods")


def test_splits_are_disjoint_and_later(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id").withColumn("p", (F.col("row_id") % 40).cast("int"))
    half = G.split_rows(df, "row_id", "cross_section")
    assert half.where("confirmation").count() == 50 and half.count() == 100
    timed = G.split_rows(df, "row_id", "time_series", "p").groupBy("confirmation").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()
    spans = {r["confirmation"]: (r["a"], r["b"]) for r in timed}
    assert spans[False][1] < spans[True][0]


def test_power_grows_with_rows():
    small, large = G.detectable_effect("spearman_rho", 50), G.detectable_effect("spearman_rho", 500)
    assert small > large > 0 and G.detectable_effect("relative_change", 100) is None
    assert 0 < G.detectable_effect("epsilon_squared", 100, 3) < 0.2


def test_attacks_catch_what_they_are_for(spark, toy):
    df, _ = toy
    strong = df.select("row_id", "age", "bmi", "area")
    assert K.alternative(strong, "age", "bmi").first()["outcome"] == "survived"
    assert K.halves(strong, K.correlation_effect("age", "bmi"), "row_id").first()["outcome"] == "survived"
    rows = [(i, float(i % 20), float(i % 20) + 100 * (i % 2), "a" if i % 2 else "b") for i in range(200)]
    simpson = spark.createDataFrame([(i, x - 60 * (g == "a"), x + 40 * (g == "a"), g) for i, x, _, g in rows], "row_id int, x double, y double, g string")
    assert K.subgroups(simpson, "x", "y", ["g"]).first()["outcome"] == "broken"
    line = df.withColumn("copy", F.col("age") * 3 + 1).withColumn("sum", F.col("age") + F.col("bmi"))
    assert K.identity(line, "age", "copy", []).first()["outcome"] == "broken"
    assert K.identity(line, "age", "sum", ["bmi"]).first()["outcome"] == "broken"
    assert K.identity(line, "age", "bmi", ["noise"]).first()["outcome"] == "survived"
    confounded = df.select("row_id", F.col("noise").alias("z"), (F.col("noise") + F.col("decoy") * 0.02).alias("x"), (F.col("noise") + F.col("bmi") * 0.02).alias("y"))
    assert K.control(confounded, "x", "y", ["z"]).first()["outcome"] in ("broken", "not_run")


def test_series_tests_find_planted_structure(spark):
    rng = np.random.default_rng(5)
    t = np.arange(60)
    frame = pd.concat(
        [
            pd.DataFrame({"s": "season", "o": t, "v": 100 + 15 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 2, 60)}),
            pd.DataFrame({"s": "noise", "o": t, "v": rng.normal(0, 2, 60)}),
            pd.DataFrame({"s": "trend", "o": t, "v": 3.0 * t + rng.normal(0, 1, 60)}),
        ]
    )
    df = spark.createDataFrame(frame)
    season = {r["series"]: r["p_value"] for r in T.seasonality_tests(df, "s", "o", "v").collect()}
    assert season["season"] == 1 / 200 and season["noise"] > 0.05
    best = {(r["series"], r["method"]): r for r in T.backtests(df, "s", "o", "v").collect()}
    assert best["season", "holt_winters"]["mase"] < 1.2 and best["trend", "trend_and_season"]["lift"] > 0.5
    assert T.trend_differenced(np.arange(5.0), 9, 1)["status"].startswith("not_run")
    first, again = (T.trend_tests(df, "s", "o", "v", 99).orderBy("series").collect() for _ in range(2))
    assert first == again
