"""Reports that go on without what they lack, and claims from scan to proof on a table with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenta.operators import association as A
from evidenta.operators import claims as L
from evidenta.operators import gateway as G
from evidenta.operators import reports as R
from evidenta.operators import statements as X
from evidenta.operators.series import trend_differenced
from evidenta.plans.config import SCAN


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(m, c, float(10 + m % 12 + c), float(5 + c), "north" if c % 2 else "south") for m in range(24) for c in range(12)]
    return spark.createDataFrame(rows, "month_no int, customer int, revenue double, cost double, place string").cache()


def test_report_runs_what_it_can(orders):
    c = R.context_of(orders, "month_no", revenue="revenue", cost="cost", customer="customer")
    assert c.measures[:2] == ["revenue", "cost"] and c.segments == ["place"] and c.pair is not None
    rows = R.exact_report(c, ["period_change", "margins", "pareto", "weighted_means", "price_volume_mix"]).collect()
    status = {r["kind"]: r["status"] for r in rows}
    assert status["period_change"] == status["margins"] == status["pareto"] == "ok"
    notes = {r["kind"]: r["note"] for r in rows if r["status"] == "not_run"}
    assert notes["weighted_means"] == "the table has no weight" and notes["price_volume_mix"] == "the table has no units"
    change = {r["subject"]: r["value"] for r in rows if r["kind"] == "period_change"}
    assert change == {"revenue": 0.0, "cost": 0.0}


def test_a_failing_or_unknown_analysis_does_not_end_the_report(orders):
    @R.register("broken", "measures")
    def broken(_):
        raise RuntimeError("no")

    try:
        rows = {r["kind"]: r for r in R.exact_report(R.Context(orders, ["revenue"], ["place"]), ["broken", "nothing", "pareto"]).collect()}
    finally:
        del R.ANALYSES["broken"]
    assert (rows["broken"]["status"], rows["broken"]["note"]) == ("not_run", "the analysis failed")
    assert rows["nothing"]["note"] == "no such analysis" and rows["pareto"]["status"] == "ok"


def test_summary_tells_the_heaviest_first(orders):
    report = R.exact_report(R.Context(orders, ["revenue"], ["place"], "month_no"), ["segment_ranking", "seasonality"])
    lines = [r["text"] for r in R.summary_lines(report).orderBy("position").collect()]
    assert lines[0].startswith("seasonality of revenue: 12 1.") and lines[1].startswith("segment ranking of place: north ")


@pytest.fixture(scope="module")
def cross(spark):
    """b follows a, c is alone, and the group shifts d."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, g = float(rng.normal()), "xy"[i % 2]
        rows.append((i, a, a + float(rng.normal()) * 0.8, float(rng.normal()), float(rng.normal()) + 1.5 * (g == "y"), g))
    df = spark.createDataFrame(rows, "rid int, alpha double, beta double, gamma double, delta double, kind string").coalesce(1).cache()
    return L.Setting(df, "rid", "cross_section", ["alpha", "beta", "gamma", "delta"], ["kind"])


def test_claims_are_proposed_on_other_rows_than_they_are_tested_on(cross):
    explore, confirm = cross.halves()
    assert explore.count() == confirm.count() == 200 and explore.join(confirm, "rid").count() == 0
    found = {r["claim_id"]: r for r in L.propose(cross).collect()}
    assert "correlation:alpha:beta" in found and found["group_difference:kind:delta"]["reference_group"] == "y"


def test_proofs_keep_the_true_claims(cross):
    proofs = {r["claim_id"]: r for r in L.prove(cross, 199, 49).collect()}
    both = proofs["correlation:alpha:beta"]
    assert both["verdict"] == "PASS" and both["scheme"] == "free" and both["low"] < both["effect"] < both["high"]
    assert both["standing"] == "PASS" and both["broken_by"] is None
    assert proofs["group_difference:kind:delta"]["verdict"] == "PASS"
    for r in proofs.values():
        assert (r["verdict"] == "PASS") == (r["outcome"] == "supported")
        assert r["outcome"] != "inconclusive" or r["detectable_effect"] is not None


def test_an_identity_is_broken_by_its_attack(spark, cross):
    df = cross.df.withColumn("sum", F.col("alpha") + F.col("gamma"))
    s = L.Setting(df, "rid", "cross_section", ["alpha", "gamma", "sum"], [])
    proofs = L.outcomes(L.test_claims(s, L.propose(s), 199), 199)
    hit = {r["claim_id"]: r["outcome"] for r in L.attack(s, proofs).where("attack = 'identity'").collect()}
    assert hit["correlation:alpha:sum"] == "broken"


def test_claims_without_a_plan_or_with_a_failed_test(spark, cross):
    claims = spark.createDataFrame(
        [("a", "seasonality", "kind", "delta", "positive", None), ("b", "group_difference", "kind", "delta", None, None)],
        "claim_id string, claim_type string, var_a string, var_b string, direction string, reference_group string",
    )
    tested = {r["claim_id"]: r for r in L.test_claims(cross, claims, 99).collect()}
    assert tested["a"]["p_value"] is None and "time axis" in tested["a"]["reason"]
    assert tested["b"]["p_value"] == 1.0 and tested["b"]["reason"] == "the test failed"
    out = {r["claim_id"]: r["outcome"] for r in L.outcomes(L.test_claims(cross, claims, 99), 99).collect()}
    assert out == {"a": "not_tested", "b": "invalid"}


def test_a_family_has_a_bound(spark):
    rows = [(f"c{i}", "correlation", "a", "b", "spearman_rho", "free", None, 0.5, 0.01, 100, 2, None, None) for i in range(41)]
    with pytest.raises(ValueError, match="at most 40"):
        L.outcomes(spark.createDataFrame(rows, L.TESTED), 99)


def test_plans_of_every_shape(spark):
    rows = [(e, p, float(e * p % 7), float(e), "uv"[e % 2], "uv"[(e + p) % 2]) for e in range(8) for p in range(24)]
    panel = spark.createDataFrame(rows, "e int, p int, y double, x double, fixed string, mixed string").cache()
    plan = lambda kind, x, y, shape, entity=None: G.assign_plan(panel, kind, x, y, shape, "p", "p", entity)
    assert plan("correlation", "x", "y", "cross_section").scheme == "free"
    assert plan("correlation", "x", "y", "panel", "e").scheme == "stratified"
    assert plan("correlation", "p", "y", "panel", "e").reason
    assert plan("group_difference", "fixed", "y", "panel", "e") == G.Plan("cluster", entity="e")
    assert plan("group_difference", "mixed", "y", "panel", "e") == G.Plan("stratified", period="p")
    assert plan("group_difference", "e", "y", "panel", "e").reason and plan("group_difference", "fixed", "y", "time_series").reason
    assert plan("trend", "p", "y", "panel", "e").scheme in ("block_differenced", None) and plan("trend", "x", "y", "panel", "e").reason
    assert plan("period_change", "p", "y", "panel", "e") == G.Plan("paired", period="p", entity="e")
    assert plan("period_change", "p", "y", "transactions") == G.Plan("free", period="p") and plan("period_change", "p", "y", "time_series").reason
    assert plan("seasonality", "p", "y", "panel", "e").scheme == "stratified" and plan("distribution", "x", "y", "panel").reason


@pytest.mark.parametrize(
    "text, expected",
    [("FY2024", ("year", "2024")), ("fy 2024", ("year", "2024")), ("2024 Q3", ("quarter", "2024Q3")), ("Q3-2024", ("quarter", "2024Q3")), ("2024/03", ("month", "2024-03")),
     ("2024-3", ("month", "2024-03")), ("2024-12", ("month", "2024-12")), ("2024-13", None), ("2024-0", None), ("Sept. 2024", ("month", "2024-09")), ("March  2024", ("month", "2024-03")), ("Foo 2024", None), ("", None)],
)
def test_period_labels(text, expected):
    assert X.parse_period(text) == expected


def test_trend_signs_are_those_of_the_raw_steps():
    """A series that only climbs: with raw steps no resample climbs as steadily but those of one sign."""
    y = np.arange(40.0) + np.random.default_rng(0).normal(size=40) * 0.01
    got = trend_differenced(y, 499, 1)
    assert got["statistic"] == pytest.approx(1.0) and 0.002 <= got["p_value"] < 0.4


def test_group_scan_takes_the_first_of_equal_medians(spark):
    from dataclasses import replace

    from evidenta.operators.candidates import scan_group_difference

    rows = [(g, float(v)) for g, vs in (("b", [1, 5, 5, 9] * 5), ("a", [0, 5, 5, 5] * 5)) for v in vs]
    out = scan_group_difference(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"], replace(SCAN, eta_squared=0.0)).first()
    assert out["reference_group"] == "a"


def test_rank_link_range_change_strata_and_gaps(spark):
    df = spark.createDataFrame([(m, float(v), "uv"[v > 4]) for m, v in ((0, 1), (1, 2), (2, 9), (12, 3), (13, 4), (26, 8))], "m int, v double, g string")
    assert A.group_link(df, "g", "v").first()["rank_eta_squared"] == pytest.approx(((2.5 - 3.5) ** 2 * 4 + (5.5 - 3.5) ** 2 * 2) / 17.5)
    span = A.seasonal_range(df, "v", "m").first()
    assert (span["peak"], span["trough"], span["positions"]) == (3, 1, 3) and span["seasonal_range"] == pytest.approx((8.5 - 2) / ((2 + 3 + 8.5) / 3))
    assert tuple(A.latest_absolute_change(df, "v", "m").first()) == (26, 13, 4.0)
    strata = {r["v"]: r["stratum"] for r in A.quartile_strata(df, "v").collect()}
    assert strata == {1.0: 0, 2.0: 0, 3.0: 1, 4.0: 2, 8.0: 3, 9.0: 3}
    filled = [(r["m"], r["v"], r["filled"]) for r in A.gaps_filled(df.where("m < 14"), "v", "m").orderBy("m").collect()]
    assert len(filled) == 14 and filled[2] == (2, 9.0, False) and filled[7][1] == pytest.approx(9 - 5 * 0.6) and filled[-1] == (13, 4.0, False)
