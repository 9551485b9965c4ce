"""Claims from scan to proof: held-back rows, plans, tests, one correction, intervals, attacks and proof records.

Claims are proposed on exploration rows and tested on confirmation rows alone.  Each step is a function of its own, so
a caller may stop after any of them; ``prove`` runs them all.  There are at most ``gate.family_max`` claims, so the
driver walks over claims, never over rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.operators import association as A
from evidenta.operators import attacks as K
from evidenta.operators import candidates as C
from evidenta.operators import gateway as G
from evidenta.operators import resampling as R
from evidenta.operators import series as T
from evidenta.plans.config import GATE, SCAN, Gate, Scan

log = logging.getLogger(__name__)

TESTED = "claim_id string, claim_type string, var_a string, var_b string, metric string, scheme string, reason string, effect double, p_value double, n_effective long, table_k long, direction string, reference_group string"


@dataclass(frozen=True)
class Setting:
    """A table and what is known of it."""

    df: DataFrame
    row_id: str
    shape: str
    numeric: list[str]
    groups: list[str]
    time: str | None = None
    ordinal: str | None = None
    entity: str | None = None
    controls: tuple[str, ...] = ()

    def halves(self, gate: Gate = GATE) -> tuple[DataFrame, DataFrame]:
        """(exploration, confirmation) rows."""
        marked = G.split_rows(self.df, self.row_id, self.shape, self.ordinal, self.entity, seed=gate.seed)
        return tuple(marked.where(c).drop("confirmation") for c in (~F.col("confirmation"), F.col("confirmation")))


def propose(s: Setting, scan: Scan = SCAN, gate: Gate = GATE) -> DataFrame:
    """Prioritised claims from the exploration rows, without redundant pairs; at most ``gate.family_max``."""
    explore, _ = s.halves(gate)
    found = C.batch(explore, s.numeric, s.groups, [s.ordinal] if s.ordinal else [], scan)
    kept = C.without_redundant(found, [*s.numeric, *s.groups])
    return kept.where(F.col("position") <= gate.family_max)


def _first(df: DataFrame, effect: str, n: str | None = "n") -> tuple[float, int | None]:
    row = df.first()
    return (None, None) if row is None else (row[effect], row[n] if n else None)


def _period_means(df: DataFrame, ordinal: str, *values: str) -> DataFrame:
    means = df.dropna(subset=[ordinal, *values]).groupBy(F.col(ordinal).alias("o")).agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)])
    return means.withColumn("series", F.lit("all"))


def _correlation(s, df, c, plan, resamples):
    stratum = plan.period if plan.scheme == "stratified" else None
    return R.correlation_test(df, c["var_a"], c["var_b"], s.row_id, resamples, stratum=stratum)


def _groups(s, df, c, plan, resamples):
    if c["reference_group"] is None:
        raise ValueError("a test of more than two groups needs a reference group")
    if plan.scheme == "cluster":
        return R.cluster_test(df, c["var_a"], c["var_b"], c["reference_group"], plan.entity, resamples)
    return R.group_test(df, c["var_a"], c["var_b"], c["reference_group"], s.row_id, resamples, stratum=plan.period)


def _trend(s, df, c, plan, resamples):
    if plan.scheme == "free":
        return R.correlation_test(df, c["var_a"], c["var_b"], s.row_id, resamples)
    return T.trend_tests(_period_means(df, s.ordinal, c["var_b"]), "series", "o", "m0", resamples)


def _steps(s, df, c, plan, resamples):
    return T.correlation_tests(_period_means(df, s.ordinal, c["var_a"], c["var_b"]), "series", "o", "m0", "m1", resamples)


def _change(s, df, c, plan, resamples):
    return R.latest_change_test(df, c["var_b"], s.ordinal, s.row_id, resamples, plan.entity)


def _season(s, df, c, plan, resamples):
    return T.seasonality_tests(_period_means(df, s.ordinal, c["var_b"]), "series", "o", "m0", resamples=resamples)


#: The test of each claim type under each scheme; what is not here is not testable.
TESTS: dict[tuple[str, str], Callable] = {
    ("correlation", "free"): _correlation, ("correlation", "stratified"): _correlation, ("correlation", "block_differenced"): _steps,
    ("group_difference", "free"): _groups, ("group_difference", "stratified"): _groups, ("group_difference", "cluster"): _groups,
    ("trend", "free"): _trend, ("trend", "block_differenced"): _trend,
    ("period_change", "free"): _change, ("period_change", "paired"): _change, ("seasonality", "stratified"): _season,
}


def plans(s: Setting, claims: DataFrame, gate: Gate = GATE) -> DataFrame:
    """(claim_id, scheme, reason, period, entity, plan_hash) of every claim, from the confirmation rows."""
    _, confirm = s.halves(gate)
    rows = []
    for c in claims.orderBy("claim_id").collect():  # at most family_max claims
        p = G.assign_plan(confirm, c["claim_type"], c["var_a"], c["var_b"], s.shape, s.ordinal, s.ordinal, s.entity)
        rows.append((c["claim_id"], p.scheme, p.reason, p.period, p.entity, p.digest()))
    return s.df.sparkSession.createDataFrame(rows, "claim_id string, scheme string, reason string, period string, entity string, plan_hash string")


def test_claims(s: Setting, claims: DataFrame, resamples: int, gate: Gate = GATE) -> DataFrame:
    """TESTED rows of every claim.  A claim without a plan has a reason and no p-value; a test that fails counts as p = 1."""
    confirm = s.halves(gate)[1].persist()
    rows = []
    for c in claims.orderBy("claim_id").collect():  # at most family_max claims
        plan = G.assign_plan(confirm, c["claim_type"], c["var_a"], c["var_b"], s.shape, s.ordinal, s.ordinal, s.entity)
        effect, p, n, reason = None, None, None, plan.reason
        if plan.scheme is not None and (c["claim_type"], plan.scheme) not in TESTS:
            reason = f"no test of type {c['claim_type']} under the scheme {plan.scheme}"
        elif plan.scheme is not None:
            try:
                found = TESTS[(c["claim_type"], plan.scheme)](s, confirm, c, plan, resamples).first()
                effect, p, n = found["statistic"], found["p_value"], confirm.dropna(subset=[c["var_a"], c["var_b"]]).count()
            except Exception:  # one test must not end the family
                log.exception("test of %s failed", c["claim_id"])
                p, reason = 1.0, "the test failed"
        rows.append((c["claim_id"], c["claim_type"], c["var_a"], c["var_b"], G.METRIC_OF[c["claim_type"]], plan.scheme, reason, effect, p, n, 2, c["direction"], c["reference_group"]))
    confirm.unpersist()
    return s.df.sparkSession.createDataFrame(rows, TESTED)


def outcomes(tested: DataFrame, resamples: int, gate: Gate = GATE) -> DataFrame:
    """One family over the claims with a p-value, then the gate; claims without a plan are ``not_tested``."""
    family = tested.where("p_value is not null")
    if family.limit(gate.family_max + 1).count() > gate.family_max:
        raise ValueError(f"a family holds at most {gate.family_max} claims")
    failed = family.withColumn("effect", F.coalesce("effect", F.lit(float("nan"))))
    decided = G.decide(failed, gate, resamples).select("claim_id", "claim_type", "var_a", "var_b", "scheme", "effect", "p_value", "q_value", "outcome", "verdict", "evidence_score", "reason", "reference_group", "metric", "n_effective")
    rest = tested.where("p_value is null").select(
        "claim_id", "claim_type", "var_a", "var_b", "scheme", "effect", "p_value", F.lit(None).cast("double").alias("q_value"),
        F.lit("not_tested").alias("outcome"), F.lit("REJECT").alias("verdict"), F.lit(None).cast("double").alias("evidence_score"), "reason", "reference_group", "metric", "n_effective",
    )
    return decided.unionByName(rest)


def effect_of(s: Setting, c) -> K.Effect:
    """The effect of a claim as a function of rows."""
    if c["claim_type"] == "group_difference":
        return K.group_effect(c["var_a"], c["var_b"], c["reference_group"])
    if c["claim_type"] == "trend":
        return lambda df: A.kendall_tau_b(_period_means(df, s.ordinal, c["var_b"]), "o", "m0", "o").select(F.col("pairs").alias("n"), F.round("tau_b", 12).alias("effect"))
    return K.correlation_effect(c["var_a"], c["var_b"])


def attack(s: Setting, proofs: DataFrame, gate: Gate = GATE) -> DataFrame:
    """(claim_id, attack, outcome) of every attack that applies to each supported claim, on its confirmation rows.

    An attack that fails is ``not_run`` and breaks nothing.
    """
    confirm = s.halves(gate)[1].persist()
    rows = []
    for c in proofs.where("verdict = 'PASS'").orderBy("claim_id").collect():  # at most family_max claims
        effect, a, b = effect_of(s, c), c["var_a"], c["var_b"]
        pair = c["claim_type"] == "correlation"
        columns = [x for x in (a, b) if x in s.numeric]
        others = [x for x in s.numeric if x not in (a, b)]
        ways: dict[str, Callable[[], DataFrame]] = {
            "trim": lambda: K.trim(confirm, effect, columns, s.row_id),
            "halves": lambda: K.halves(confirm, effect, s.row_id, s.ordinal),
        }
        if pair:
            ways["alternative"] = lambda: K.alternative(confirm, a, b)
            ways["identity"] = lambda: K.identity(confirm, a, b, others)
            if controls := [x for x in s.controls if x not in (a, b)]:
                ways["control"] = lambda: K.control(confirm, a, b, controls)
            if s.groups:
                ways["subgroups"] = lambda: K.subgroups(confirm, a, b, s.groups)
            if s.ordinal:
                ways["detrend"] = lambda: K.detrend(confirm, a, b, s.ordinal, s.entity)
        for name, run in ways.items():
            try:
                found = [r["outcome"] for r in run().collect()]  # one row, or one per grouping column
                worst = "broken" if "broken" in found else "survived" if "survived" in found else "not_run"
            except Exception:  # one attack must not end the others
                log.exception("attack %s on %s failed", name, c["claim_id"])
                worst = "not_run"
            rows.append((c["claim_id"], name, worst))
    confirm.unpersist()
    return s.df.sparkSession.createDataFrame(rows, "claim_id string, attack string, outcome string")


def intervals(s: Setting, proofs: DataFrame, resamples: int, gate: Gate = GATE) -> DataFrame:
    """(claim_id, low, high) of the supported correlations; the unit that is drawn follows the test's null."""
    _, confirm = s.halves(gate)
    rows = []
    for c in proofs.where("verdict = 'PASS' and claim_type = 'correlation'").orderBy("claim_id").collect():  # at most family_max
        unit = s.ordinal if c["scheme"] in ("stratified", "block_differenced") else s.row_id
        got = R.effect_interval(confirm, c["var_a"], c["var_b"], unit, resamples).first()
        rows.append((c["claim_id"], got["low"], got["high"]))
    return s.df.sparkSession.createDataFrame(rows, "claim_id string, low double, high double")


def power_gaps(proofs: DataFrame) -> DataFrame:
    """(claim_id, metric, n_effective, detectable_effect) of the inconclusive claims."""
    return G.power_notes(proofs)


def prove(s: Setting, resamples: int, interval_resamples: int, scan: Scan = SCAN, gate: Gate = GATE) -> DataFrame:
    """Proof records: outcome, interval, what broke a claim and its standing.  Invariants are checked before they are returned."""
    tested = test_claims(s, propose(s, scan, gate), resamples, gate)
    proofs = outcomes(tested, resamples, gate).persist()
    if (bad := G.invariant_violations(proofs.where("p_value is not null")).limit(5).collect()):
        raise AssertionError(f"proof records break their rules: {bad}")
    stood = K.fragility(proofs, attack(s, proofs, gate))
    told = stood.join(intervals(s, proofs, interval_resamples, gate), "claim_id", "left").join(power_gaps(proofs).select("claim_id", "detectable_effect"), "claim_id", "left")
    return told.select(
        "claim_id", "claim_type", "var_a", "var_b", "scheme", "effect", "p_value", "q_value", "outcome", "verdict", "evidence_score", "low", "high",
        "detectable_effect", "broken_by", "standing", "reason",
    )
