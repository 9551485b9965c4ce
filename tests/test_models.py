"""Fitted models on small tables whose answer is known."""

import numpy as np
import pytest

from evidenta.operators import models as M


@pytest.fixture(scope="module")
def made(spark):
    """y follows a and the label; b is noise; c is rare and only the minority class of z has it."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        a, b, g = float(rng.normal()), float(rng.normal()), "uv"[i % 2]
        rows.append((i, a, b, g, 2 * a + 3 * (g == "v") + float(rng.normal()) * 0.2, "rare" if a > 1.2 else "usual"))
    return spark.createDataFrame(rows, "rid int, a double, b double, g string, y double, z string").coalesce(1).cache()


def test_drivers_explain_held_out_rows(made):
    out = {r["model"]: r for r in M.driver_regression(made, "y", ["a", "b"], ["g"], "rid", 3).collect()}
    assert out["ridge"]["r2"] > 0.9 and out["ridge"]["status"] == "ok"
    few = M.driver_regression(made.limit(20), "y", ["a"], [], "rid", 3).collect()
    assert [r["status"] for r in few] == ["not_run"]


def test_importance_names_the_drivers(made):
    out = {r["feature"]: r for r in M.driver_importance(made, "y", ["a", "b"], ["g"], "rid", 3).collect()}
    assert min(out["a"]["importance"], out["g"]["importance"]) > 10 * abs(out["b"]["importance"])
    assert out["a"]["status"] == "ok" and out["a"]["low"] <= out["a"]["importance"] <= out["a"]["high"]


def test_classes_weigh_alike(made):
    out = {r["model"]: r for r in M.driver_classification(made, "z", ["a", "b"], [], "rid", 3).collect()}
    assert all(r["baseline"] == pytest.approx(0.5) for r in out.values())
    assert out["logistic"]["balanced_accuracy"] > 0.9 and out["forest"]["lift"] > 0.3


def test_balanced_accuracy_is_the_mean_recall(spark):
    rows = [(0.0, 0.0)] * 8 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 1 + [(1.0, 0.0)] * 3
    got = M.balanced_accuracy(spark.createDataFrame(rows, "y double, prediction double"))
    assert got == pytest.approx((0.8 + 0.25) / 2)
    weights = {r["y"]: r["weight"] for r in M.class_weights(spark.createDataFrame(rows, "y double, prediction double")).collect()}
    assert weights == {0.0: pytest.approx(14 / 20), 1.0: pytest.approx(14 / 8)}


def test_adjusted_association_finds_what_controls_do_not_hold(made):
    row = M.adjusted_association(made, "a", "y", ["b"], "rid", 3).first()
    assert row["metric"] == "r2" and row["lift"] > 0.5 and row["sign_agreement"] == 1.0 and row["status"] == "ok"
    assert M.adjusted_association(made, "b", "y", ["a"], "rid", 3).first()["status"] == "no_lift"


def test_segments_need_stable_and_large_clusters(spark):
    rng = np.random.default_rng(1)
    blobs = [(i, *(np.array([[0, 0], [8, 8], [0, 8]][i % 3]) + rng.normal(size=2) * 0.5).tolist()) for i in range(180)]
    out = {r["k"]: r for r in M.segments(spark.createDataFrame(blobs, "rid int, a double, b double"), ["a", "b"], "rid", 4, 2).collect()}
    assert out[3]["status"] == "ok" and out[3]["bootstrap_ari"] > 0.9 and out[3]["least_share"] == pytest.approx(1 / 3, abs=0.01)
    noise = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(180, 2)))]
    flat = M.segments(spark.createDataFrame(noise, "rid int, a double, b double"), ["a", "b"], "rid", 3, 2).where("status <> 'not_chosen'").first()
    assert flat["status"] != "ok"


def test_anomalies_flag_the_far_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *rng.normal(size=2).tolist()) for i in range(300)] + [(1000, 9.0, 9.0), (1001, -9.0, 9.0)]
    out = {r["row_id"]: r for r in M.anomalies(spark.createDataFrame(rows, "rid int, a double, b double"), ["a", "b"], "rid", trees=40).collect()}
    assert {1000, 1001} <= set(out) and out[1000]["shifted"] and out[1000]["status"] == "ok"
    assert M.rank_agreement(np.array([[1, 2, 3, 4], [4, 3, 2, 1]])) == pytest.approx(-1)


def test_components_against_numpy_and_shuffled_columns(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(400, 1))
    x = np.hstack([f + 0.3 * rng.normal(size=(400, 1)) for _ in range(3)] + [rng.normal(size=(400, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "rid int, a double, b double, c double, d double, e double")
    out = M.components(df, list("abcde"), row_id="rid").collect()
    exact = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose([r["eigenvalue"] for r in out], exact) and [r["kept"] for r in out] == [True, False, False, False, False]
    assert out[0]["stability"] > 0.95
    shuffled = [np.sort(np.linalg.eigvalsh(np.corrcoef([rng.permutation(c) for c in x.T])))[::-1] for _ in range(20)]
    assert np.allclose([r["null"] for r in out], np.quantile(shuffled, 0.95, axis=0), atol=0.08)


def test_poisson_weights_have_mean_and_variance_one(spark):
    from pyspark.sql import functions as F

    row = spark.range(20_000).select(M.poisson_weight(F.md5(F.col("id").cast("string"))).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert row["m"] == pytest.approx(1, abs=0.03) and row["v"] == pytest.approx(1, abs=0.05)


def test_threshold_finds_the_bend(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(max(x - 5, 0) * 3 + rng.normal() * 0.1)) for i, x in enumerate(rng.uniform(0, 10, 300))]
    row = M.threshold_fit(spark.createDataFrame(rows, "rid int, x double, y double"), "x", "y", "rid").first()
    assert row["bend"] == pytest.approx(5, abs=0.6) and row["status"] == "ok"


def test_time_folds_follow_the_calendar(spark):
    df = spark.createDataFrame([(p, i) for p in range(12) for i in range(2)], "p int, i int")
    folds = {r["p"]: r["fold"] for r in M.time_folds(df, "p", 5).collect()}
    assert sorted(set(folds.values())) == list(range(6)) and all(folds[p] <= folds[p + 1] for p in range(11))


def test_nearest_neighbours_average_the_close_rows(spark):
    train = spark.createDataFrame([(float(i), float(i // 10)) for i in range(100)], "a double, t double")
    asked = spark.createDataFrame([(1, 5.0), (2, 55.0)], "rid int, a double")
    out = {r["rid"]: r["prediction"] for r in M.nearest_neighbours(train, asked, ["a"], "t", "rid", 3, 8).collect()}
    assert out == {1: 0.0, 2: 5.0}
