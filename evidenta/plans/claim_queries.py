"""Registered queries of candidate scans, resampling tests, the gate and attacks, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenta.operators import attacks as K
from evidenta.operators import candidates as C
from evidenta.operators import gateway as G
from evidenta.operators import resampling as R
from evidenta.plans.association_queries import rank_sql
from evidenta.plans.config import GATE, STORY_WEIGHTS
from evidenta.plans.exact_queries import rounded
from evidenta.plans.views import REGION_MONTH_SQL, SALES_SQL, WHOLE_SQL, region_month, sales, table, whole_months

#: Resamples of the registered tests (the gate itself takes 10,000) and draws of the intervals.
SEED, B, DRAWS = GATE.seed, 999, GATE.interval_resamples


def _suppliers(spark, d):
    return table(spark, d, "supplier")


def _orders_flat(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "o_orderstatus", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no"), F.col("c_nationkey").alias("nation")
    )


def scan_correlation(spark, d):
    return rounded(C.scan_correlation(region_month(spark, d), ["revenue", "cost", "units", "lines"]), 9)


def scan_group_difference(spark, d):
    return rounded(C.scan_group_difference(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], _loose()), 9)


def scan_trend(spark, d):
    return rounded(C.scan_trend(region_month(spark, d), ["month_no"], ["revenue", "units", "lines"], _loose()), 9)


def _loose():
    from dataclasses import replace

    from evidenta.plans.config import SCAN

    return replace(SCAN, eta_squared=0.0, tau=0.01)


def prioritise(spark, d):
    p = region_month(spark, d)
    both = C.scan_correlation(p, ["revenue", "cost", "units", "lines"]).unionByName(C.scan_trend(p, ["month_no"], ["revenue", "units", "lines"]))
    return rounded(C.with_ids(C.prioritise(both, 5)), 9)


def screen_words(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.element_at(F.array(*[F.lit(w) for w in _CLAIMS]), (F.col("o_custkey") % len(_CLAIMS) + 1).cast("int")), F.lit(" "), F.col("o_orderpriority")).alias("claim"))
    return C.screen_words(o).select("id", "screen")


_CLAIMS = (
    "price rises with size in", "price always rises in", "discount causes returns in", "overall allowances grow in", "no one orders twice in", "growth leading to returns in",
    "orders, without exception, grow in", "remaking causeways is dear in", "The effect of size on price in", "guaranteed delivery and making time in",
)


def split_random(spark, d):
    return G.split_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", "cross_section")


def split_time(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no"))
    return G.split_rows(s, "o_orderkey", "transactions", "month_no")


def split_entity(spark, d):
    p = sales(spark, d, "nation", "month_no").groupBy("nation", "month_no").agg(F.count(F.lit(1)).alias("lines"))
    return G.split_rows(p, "nation", "panel", "month_no", "nation")


def perm_free(spark, d):
    return rounded(R.correlation_test(_suppliers(spark, d), "s_nationkey", "s_acctbal", "s_suppkey", B), 9)


def perm_stratified(spark, d):
    p = region_month(spark, d).withColumn("row_id", F.concat_ws("-", "region", "month_no"))
    return rounded(R.correlation_test(p, "units", "lines", "row_id", B, stratum="month_no"), 9)


def perm_groups(spark, d):
    return rounded(R.group_test(_suppliers(spark, d).withColumn("low", (F.col("s_nationkey") < 12).cast("string")), "low", "s_acctbal", "true", "s_suppkey", B), 9)


def perm_cluster(spark, d):
    s = _suppliers(spark, d).withColumn("low", (F.col("s_nationkey") < 12).cast("string"))
    return rounded(R.cluster_test(s, "low", "s_acctbal", "true", "s_nationkey", B), 9)


def perm_paired(spark, d):
    p = whole_months(sales(spark, d, "nation", "month_no", "revenue"), spark, d).groupBy("nation", "month_no").agg(F.sum("revenue").cast("double").alias("revenue"))
    return rounded(R.paired_change_test(p, "revenue", "nation", "month_no", B), 9)


def perm_unpaired(spark, d):
    e = table(spark, d, "events").withColumn("day", F.datediff("ts", F.lit("2024-01-01").cast("date")))
    return rounded(R.latest_change_test(e, "value", "day", "event_id", B), 9)


def effect_interval(spark, d):
    return rounded(R.effect_interval(_suppliers(spark, d), "s_nationkey", "s_acctbal", "s_suppkey", DRAWS), 6)


def effect_interval_entities(spark, d):
    return rounded(R.effect_interval(region_month(spark, d), "units", "lines", "region", DRAWS), 6)


def bootstrap_ci(spark, d):
    return rounded(R.bootstrap_mean(_suppliers(spark, d), "s_acctbal", "s_suppkey", DRAWS), 3)


def _tested(spark, d):
    """A claims table with p-values and effects from the nations' figures, so that every outcome occurs."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("c"), F.lpad(k.cast("string"), 2, "0")).alias("claim_id"), ((k % 10 + 1) / F.lit(1000.0)).alias("p_value"),
        F.element_at(F.array(*[F.lit(m) for m in _METRICS]), (k % 4 + 1).cast("int")).alias("metric"),
        ((k % 7 - 2) / F.lit(12.0)).alias("effect"), F.when(k % 3 == 0, "positive").alias("direction"), (k + 50).cast("long").alias("n_effective"),
    )


_METRICS = ("spearman_rho", "kendall_tau_b", "cliffs_delta", "epsilon_squared")


def bh_qvalues(spark, d):
    return rounded(R.benjamini_hochberg(_tested(spark, d)).select("claim_id", "p_value", "q_value", "family"), 9)


def bh_rejections(spark, d):
    return rounded(R.rejections(R.benjamini_hochberg(_tested(spark, d)), 0.01).select("claim_id", "q_value"), 9)


def gate_outcomes(spark, d):
    return rounded(G.decide(_tested(spark, d)).select("claim_id", "q_value", "gated_effect", "observed_direction", "outcome", "verdict"), 9)


def evidence_score(spark, d):
    return rounded(G.memory_guard(G.decide(_tested(spark, d))).select("claim_id", "evidence_score"), 7)


def proof_invariants(spark, d):
    proofs = G.decide(_tested(spark, d))
    bad = proofs.withColumn("verdict", F.when(F.col("claim_id") == "c03", "PASS").otherwise(F.col("verdict"))).withColumn("q_value", F.when(F.col("claim_id") == "c04", 0.0).otherwise(F.col("q_value")))
    return G.invariant_violations(bad)


def power_notes(spark, d):
    weak = _tested(spark, d).withColumn("p_value", F.lit(0.9))
    return rounded(G.power_notes(G.decide(weak).where("outcome = 'inconclusive'")), 6)


def spec_hash(spark, d):
    return G.spec_hash(_tested(spark, d).select("claim_id", "metric"), ["metric", "claim_id"])


def look_ledger(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("at"), (F.col("user_id") % 7).cast("string").alias("digest"))
    return G.look_ledger(e).select("run_id", "digest", "prior_looks", "runs")


def data_digest(spark, d):
    return G.data_digest(table(spark, d, "nation").select("n_name", "n_regionkey"))


def story_order(spark, d):
    kinds = list(STORY_WEIGHTS)
    items = table(spark, d, "nation").select(F.concat(F.lit("item"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("item_id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("n_nationkey") % 16 + 1).cast("int")).alias("kind"), (F.col("n_nationkey") % 5).alias("bonus"))
    return G.story(items, STORY_WEIGHTS).select("item_id", "kind", "weight", "lead", "position")


def attack_trim(spark, d):
    o = _orders_flat(spark, d).withColumn("skewed", F.pow(F.col("o_totalprice"), F.lit(3)))
    return rounded(K.trim(o, K.correlation_effect("skewed", "c_acctbal"), ["skewed"], "o_orderkey"), 8)


def attack_halves(spark, d):
    return rounded(K.halves(region_month(spark, d), K.correlation_effect("units", "lines"), "month", "month_no"), 8)


def attack_control(spark, d):
    return rounded(K.control(region_month(spark, d), "revenue", "cost", ["month_no"] + ["lines"]), 8)


def attack_subgroups(spark, d):
    return rounded(K.subgroups(_orders_flat(spark, d), "o_totalprice", "c_acctbal", ["c_mktsegment", "o_orderstatus"]), 7)


def attack_alternative(spark, d):
    return rounded(K.alternative(region_month(spark, d), "revenue", "units"), 8)


def attack_detrend(spark, d):
    return rounded(K.detrend(region_month(spark, d), "revenue", "units", "month_no", "region"), 8)


def attack_identity(spark, d):
    p = region_month(spark, d).withColumn("profit", F.col("revenue") - F.col("cost"))
    return K.identity(p, "profit", "revenue", ["cost", "units"])


def skeptic_controls(spark, d):
    return rounded(K.skeptic(region_month(spark, d), "revenue", "cost", ["units", "lines"]), 8)


def fragility(spark, d):
    proofs = G.decide(_tested(spark, d)).select("claim_id", "verdict")
    hits = table(spark, d, "nation").select(F.concat(F.lit("c"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("claim_id"), F.element_at(F.array(F.lit("trim"), F.lit("halves")), (F.col("n_regionkey") % 2 + 1).cast("int")).alias("attack"), F.when(F.col("n_nationkey") % 2 == 0, "broken").otherwise("survived").alias("outcome"))
    return K.fragility(proofs, hits)


QUERIES = {
    f.__name__: f
    for f in (
        scan_correlation, scan_group_difference, scan_trend, prioritise, screen_words, split_random, split_time, split_entity, perm_free, perm_stratified,
        perm_groups, perm_cluster, perm_paired, perm_unpaired, effect_interval, effect_interval_entities, bootstrap_ci, bh_qvalues, bh_rejections, gate_outcomes, evidence_score, proof_invariants, power_notes, spec_hash,
        look_ledger, data_digest, story_order, attack_trim, attack_halves, attack_control, attack_subgroups, attack_alternative, attack_detrend,
        attack_identity, skeptic_controls, fragility,
    )
}

_P = f"WITH {SALES_SQL}, {REGION_MONTH_SQL}"
_PANEL = ("revenue", "cost", "units", "lines")
_PR = f"{_P}, r AS (SELECT *, {', '.join(f'{rank_sql(c)} AS r_{c}' for c in _PANEL)}, {rank_sql('month_no')} AS r_month_no FROM region_month)"
_CORR = " UNION ALL ".join(f"SELECT 'correlation' AS claim_type, '{a}' AS var_a, '{b}' AS var_b, corr(r_{a}, r_{b}) AS rho, count(*) AS n FROM r" for i, a in enumerate(_PANEL) for b in _PANEL[i + 1 :])
_TREND = " UNION ALL ".join(
    f"""SELECT 'trend' AS claim_type, 'month_no' AS var_a, '{v}' AS var_b, (SELECT sum(sign(b.t - a.t) * sign(b.v - a.v)) / sqrt(sum(abs(sign(b.t - a.t))) * sum(abs(sign(b.v - a.v))))
 FROM (SELECT month_no AS t, round(avg({v}), 9) AS v FROM region_month GROUP BY 1) a JOIN (SELECT month_no AS t, round(avg({v}), 9) AS v FROM region_month GROUP BY 1) b ON a.t < b.t) AS rho, count(*) AS n FROM region_month"""
    for v in ("revenue", "units", "lines")
)
_SIGNED = "round(abs(rho), 9) AS magnitude, CASE WHEN rho > 0 THEN 'positive' WHEN rho < 0 THEN 'negative' END AS direction, CAST(NULL AS VARCHAR) AS reference_group, n"


def _group_scan(g: str, v: str) -> str:
    return f"""SELECT '{g}' AS g, '{v}' AS v, sum(n * (m - gm) ** 2) / (max(gv) * max(gn)) AS eta, max(gn) AS n, count(*) AS k, first(lv ORDER BY med DESC, lv) AS top FROM
(SELECT {g} AS lv, count(*) AS n, avg({v}) AS m, median({v}) AS med FROM lineitem GROUP BY 1), (SELECT avg({v}) AS gm, var_pop({v}) AS gv, count(*) AS gn FROM lineitem)"""


_TESTED = """k AS (SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS claim_id, (n_nationkey % 10 + 1) / 1000.0::DOUBLE AS p_value, (['spearman_rho', 'kendall_tau_b', 'cliffs_delta', 'epsilon_squared'])[n_nationkey % 4 + 1] AS metric,
  (n_nationkey % 7 - 2) / 12.0::DOUBLE AS effect, CASE WHEN n_nationkey % 3 = 0 THEN 'positive' END AS direction FROM nation),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, claim_id) AS rn, count(*) OVER () AS family FROM k),
q AS (SELECT *, least(1.0, min(p_value * family / rn) OVER (ORDER BY rn DESC)) AS q_value FROM rk)"""
_GATE = _TESTED + """, b AS (SELECT *, CASE metric WHEN 'spearman_rho' THEN 0.10 WHEN 'kendall_tau_b' THEN 0.07 WHEN 'cliffs_delta' THEN 0.15 ELSE 0.10 END AS lo,
  CASE metric WHEN 'spearman_rho' THEN 0.50 WHEN 'kendall_tau_b' THEN 0.35 WHEN 'cliffs_delta' THEN 0.47 ELSE 0.50 END AS hi, CASE WHEN metric = 'epsilon_squared' THEN sqrt(abs(effect)) ELSE abs(effect) END AS size,
  CASE WHEN metric <> 'epsilon_squared' AND effect > 0 THEN 'positive' WHEN metric <> 'epsilon_squared' AND effect < 0 THEN 'negative' END AS seen FROM q),
g AS (SELECT *, CASE WHEN q_value >= 0.05 THEN 'inconclusive' WHEN size < lo THEN 'negligible' WHEN coalesce(direction <> seen, false) THEN 'refuted' ELSE 'supported' END AS outcome FROM b)"""


def _perm(source: str, x: str, y: str, rid: str, stratum: str = "0", with_: str = "WITH ") -> str:
    return f"""{with_} a AS (SELECT {rid} AS rid, {stratum} AS st, {rank_sql(x)} AS rx, {rank_sql(y)} AS ry FROM {source}), p AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY rid) AS i FROM a),
m AS (SELECT count(*) AS n, avg(rx) AS mx, avg(ry) AS my, stddev_pop(rx) AS sx, stddev_pop(ry) AS sy, sum(rx * ry) AS t FROM p),
s AS (SELECT b, st, ry, row_number() OVER (PARTITION BY b, st ORDER BY md5('{SEED}:' || b || ':' || rid), rid) AS j FROM p, (SELECT unnest(range({B})) AS b)),
d AS (SELECT b, sum(rx * s.ry) AS t FROM s JOIN p ON p.st = s.st AND p.i = s.j GROUP BY 1),
o AS (SELECT round((t / n - mx * my) / (sx * sy), 12) AS stat FROM m), e AS (SELECT round((d.t / n - mx * my) / (sx * sy), 12) AS stat FROM d, m),
c AS (SELECT count(*) AS resamples, count(*) FILTER (abs(e.stat) >= abs(o.stat) - 1e-12) AS extreme, max(o.stat) AS stat FROM e, o)
SELECT round(stat, 9) AS statistic, resamples, extreme, round((extreme + 1) / (resamples + 1), 9) AS p_value FROM c"""


def _delta_sql(body: str) -> str:
    return body + """, c AS (SELECT count(*) AS resamples, count(*) FILTER (abs(e.stat) >= abs(o.stat) - 1e-12) AS extreme, max(o.stat) AS stat FROM e, o)
SELECT round(stat, 9) AS statistic, resamples, extreme, round((extreme + 1) / (resamples + 1), 9) AS p_value FROM c"""


def _interval(rows: str, with_: str = "WITH") -> str:
    return f"""{with_} r AS ({rows}), u AS (SELECT unit, row_number() OVER (ORDER BY unit) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM r)),
k AS (SELECT b, CAST('0x' || substr(md5('{SEED}:' || b || ':' || i), 1, 8) AS BIGINT) % n + 1 AS j FROM u, (SELECT unnest(range({DRAWS})) AS b)), g AS (SELECT b, x, y FROM k JOIN u ON u.i = k.j JOIN r ON r.unit = u.unit),
e AS (SELECT b, round(corr(rx, ry), 9) AS e FROM (SELECT b, {rank_sql('x', 'b')} AS rx, {rank_sql('y', 'b')} AS ry FROM g) GROUP BY 1)
SELECT count(*) AS resamples, count(e) AS valid, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high FROM e"""


def _rho_sql(where: str = "", source: str = "region_month", x: str = "units", y: str = "lines") -> str:
    return f"(SELECT count(*) AS n, coalesce(corr(rx, ry), 0) AS e FROM (SELECT {rank_sql(x)} AS rx, {rank_sql(y)} AS ry FROM {source} {where}))"


_JUDGE = "CASE WHEN attacked IS NULL THEN 'not_run' WHEN sign(attacked) = -sign(original) OR abs(attacked) < 0.5 * abs(original) THEN 'broken' ELSE 'survived' END AS outcome"
_FLAT = """f AS (SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)"""
_SUB = lambda c: f"""SELECT '{c}' AS column_name, lv, n, e FROM (SELECT lv, count(*) AS n, corr(rx, ry) AS e FROM (SELECT {c} AS lv, {rank_sql('o_totalprice', c)} AS rx, {rank_sql('c_acctbal', c)} AS ry FROM f) GROUP BY 1)"""

ORACLES = {
    "scan_correlation": f"{_PR}, m AS ({_CORR}) SELECT claim_type, var_a, var_b, {_SIGNED} FROM m WHERE n >= 30 AND abs(rho) >= 0.15",
    "scan_trend": f"{_P}, m AS ({_TREND}) SELECT claim_type, var_a, var_b, {_SIGNED} FROM m WHERE abs(rho) >= 0.01",
    "scan_group_difference": "WITH m AS (" + " UNION ALL ".join(_group_scan(g, v) for g in ("l_returnflag", "l_linestatus") for v in ("l_quantity", "l_extendedprice")) + """)
SELECT 'group_difference' AS claim_type, g AS var_a, v AS var_b, round(eta, 9) AS magnitude, CASE WHEN k = 2 THEN 'positive' END AS direction, CASE WHEN k = 2 THEN top END AS reference_group, n FROM m WHERE k BETWEEN 2 AND 10""",
    "prioritise": f"""{_PR}, m AS ((SELECT * FROM ({_CORR}) WHERE n >= 30 AND abs(rho) >= 0.15) UNION ALL (SELECT * FROM ({_TREND}) WHERE abs(rho) >= 0.10)),
p AS (SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY abs(rho) DESC, var_a, var_b) = 1 AS res FROM m), o AS (SELECT *, row_number() OVER (ORDER BY res DESC, abs(rho) DESC, claim_type, var_a, var_b) AS position FROM p)
SELECT claim_type, var_a, var_b, {_SIGNED}, CAST(position AS INTEGER) AS position, claim_type || ':' || var_a || ':' || var_b AS claim_id FROM o WHERE position <= 5""",
    "screen_words": f"""WITH t AS (SELECT o_orderkey AS id, ({list(_CLAIMS)!r})[o_custkey % {len(_CLAIMS)} + 1] || ' ' || o_orderpriority AS claim FROM orders)
SELECT id, CASE WHEN regexp_matches(claim, '(?i)\\b({"|".join(C.UNIVERSAL_WORDS)})\\b') THEN 'universal' WHEN regexp_matches(claim, '(?i)\\b({"|".join(C.CAUSAL_WORDS)})\\b') THEN 'causal' END AS screen FROM t""",
    "split_random": f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('{SEED}:' || c_custkey), c_custkey) AS rn, count(*) OVER () AS n FROM customer) SELECT c_custkey, rn <= round_even(n * 0.5, 0) AS confirmation FROM r""",
    "split_time": """WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no FROM orders), p AS (SELECT DISTINCT month_no FROM o), r AS (SELECT month_no, row_number() OVER (ORDER BY month_no DESC) AS rn, count(*) OVER () AS n FROM p),
h AS (SELECT min(month_no) AS cut FROM r WHERE rn <= CASE WHEN ceil(n * 0.5) < 20 AND n >= 28 THEN 20 ELSE ceil(n * 0.5) END) SELECT o_orderkey, month_no, month_no >= cut AS confirmation FROM o, h""",
    "split_entity": f"""WITH {SALES_SQL}, p AS (SELECT nation, month_no, count(*) AS lines FROM sales GROUP BY 1, 2), u AS (SELECT nation, row_number() OVER (ORDER BY md5('{SEED}:' || nation), nation) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT nation FROM p))
SELECT p.nation, month_no, lines, rn <= round_even(n * 0.5, 0) AS confirmation FROM p JOIN u ON p.nation = u.nation""",
    "perm_free": _perm("supplier", "s_nationkey", "s_acctbal", "s_suppkey"),
    "perm_stratified": _perm("region_month", "units", "lines", "region || '-' || month_no", "month_no", f"{_P},"),
    "perm_groups": _delta_sql(f"""WITH a AS (SELECT s_suppkey AS rid, CAST(s_nationkey < 12 AS INTEGER) AS a, {rank_sql('s_acctbal')} AS r FROM supplier), p AS (SELECT *, row_number() OVER (ORDER BY rid) AS i FROM a), z AS (SELECT sum(a) AS na, sum(1 - a) AS nb, sum(a * r) AS t FROM p),
s AS (SELECT b, a, row_number() OVER (PARTITION BY b ORDER BY md5('{SEED}:' || b || ':' || rid), rid) AS j FROM p, (SELECT unnest(range({B})) AS b)), d AS (SELECT b, sum(r) AS t FROM s JOIN p ON p.i = s.j WHERE s.a = 1 GROUP BY 1),
o AS (SELECT round(2 * (t - na * (na + 1) / 2) / (na * nb) - 1, 12) AS stat FROM z), e AS (SELECT round(2 * (d.t - na * (na + 1) / 2) / (na * nb) - 1, 12) AS stat FROM d, z)"""),
    "perm_cluster": _delta_sql(f"""WITH r AS (SELECT s_nationkey AS e, CAST(s_nationkey < 12 AS INTEGER) AS a, {rank_sql('s_acctbal')} AS r FROM supplier), u AS (SELECT e, min(a) AS a, sum(r) AS sr, count(*) AS m FROM r GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY e) AS i, sum(m) OVER () AS n FROM u),
s AS (SELECT b, a, row_number() OVER (PARTITION BY b ORDER BY md5('{SEED}:' || b || ':' || e), e) AS j FROM p, (SELECT unnest(range({B})) AS b)), d AS (SELECT b, sum(sr) AS t, sum(m) AS na, max(n) AS n FROM s JOIN p ON p.i = s.j WHERE s.a = 1 GROUP BY 1),
z AS (SELECT sum(CASE WHEN a = 1 THEN sr END) AS t, sum(CASE WHEN a = 1 THEN m END) AS na, max(n) AS n FROM p), o AS (SELECT round(2 * (t - na * (na + 1) / 2) / (na * (n - na)) - 1, 12) AS stat FROM z), e AS (SELECT round(2 * (t - na * (na + 1) / 2) / (na * (n - na)) - 1, 12) AS stat FROM d)"""),
    "perm_paired": _delta_sql(f"""WITH {SALES_SQL}, {WHOLE_SQL}, v AS (SELECT nation, month_no, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales, last_month WHERE NOT (incomplete AND month_no = cut_month) GROUP BY 1, 2), l AS (SELECT max(month_no) AS now, (SELECT max(month_no) FROM v WHERE month_no < (SELECT max(month_no) FROM v)) AS bef FROM v),
st AS (SELECT a.nation AS e, b.revenue AS v0, a.revenue - b.revenue AS step FROM v a JOIN v b ON a.nation = b.nation JOIN l ON a.month_no = now AND b.month_no = bef), sc AS (SELECT avg(v0) AS m0, count(*) AS k, sum(step) AS t FROM st),
d AS (SELECT b, sum(step * CASE WHEN substr(md5('{SEED}:' || b || ':' || e), 1, 1) >= '8' THEN -1.0 ELSE 1.0 END) AS t FROM st, (SELECT unnest(range({B})) AS b) GROUP BY 1), o AS (SELECT round(t / k / abs(m0), 12) AS stat FROM sc), e AS (SELECT round(d.t / k / abs(m0), 12) AS stat FROM d, sc)"""),
    "perm_unpaired": _delta_sql(f"""WITH ev AS (SELECT event_id AS rid, CAST(ts AS DATE) - DATE '2024-01-01' AS day, CAST(value AS DECIMAL(18,4)) AS v FROM events WHERE value IS NOT NULL),
l AS (SELECT max(day) AS now, (SELECT max(day) FROM ev WHERE day < (SELECT max(day) FROM ev)) AS bef FROM ev), r AS (SELECT rid, v, CAST(day = now AS INTEGER) AS a FROM ev, l WHERE day IN (now, bef)), p AS (SELECT *, row_number() OVER (ORDER BY rid) AS i FROM r),
z AS (SELECT sum(a) AS n1, sum(1 - a) AS n0, CAST(sum(v) AS DOUBLE) AS al, CAST(sum(CASE WHEN a = 1 THEN v END) AS DOUBLE) AS t FROM p), s AS (SELECT b, a, row_number() OVER (PARTITION BY b ORDER BY md5('{SEED}:' || b || ':' || rid), rid) AS j FROM p, (SELECT unnest(range({B})) AS b)),
d AS (SELECT b, CAST(sum(v) AS DOUBLE) AS t FROM s JOIN p ON p.i = s.j WHERE s.a = 1 GROUP BY 1), o AS (SELECT round((t / n1 - (al - t) / n0) / abs((al - t) / n0), 12) AS stat FROM z), e AS (SELECT round((d.t / n1 - (al - d.t) / n0) / abs((al - d.t) / n0), 12) AS stat FROM d, z)"""),
    "effect_interval": _interval("SELECT s_suppkey AS unit, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y FROM supplier"),
    "effect_interval_entities": _interval("SELECT region AS unit, units AS x, CAST(lines AS DOUBLE) AS y FROM region_month", f"{_P},"),
    "bootstrap_ci": f"""WITH p AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier), k AS (SELECT b, CAST('0x' || substr(md5('{SEED}:' || b || ':' || i), 1, 8) AS BIGINT) % n + 1 AS j FROM p, (SELECT unnest(range({DRAWS})) AS b)),
m AS (SELECT b, round(avg(v), 9) AS m FROM k JOIN p ON p.i = k.j GROUP BY 1) SELECT count(*) AS resamples, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m""",
    "bh_qvalues": f"WITH {_TESTED} SELECT claim_id, round(p_value, 9) AS p_value, round(q_value, 9) AS q_value, family FROM q",
    "bh_rejections": f"WITH {_TESTED} SELECT claim_id, round(q_value, 9) AS q_value FROM q WHERE q_value < 0.01",
    "gate_outcomes": f"WITH {_GATE} SELECT claim_id, round(q_value, 9) AS q_value, round(size, 9) AS gated_effect, seen AS observed_direction, outcome, CASE WHEN outcome = 'supported' THEN 'PASS' ELSE 'REJECT' END AS verdict FROM g",
    "evidence_score": f"WITH {_GATE} SELECT claim_id, round(pow(least(1, ln(0.05 / q_value) / ln(0.05 * 10001)) * greatest(0, least(1, (size - lo) / (hi - lo))), 1.0 / 3), 7) AS evidence_score FROM g WHERE outcome = 'supported'",
    "proof_invariants": f"""WITH {_GATE}, h AS (SELECT claim_id, p_value, outcome, CASE WHEN claim_id = 'c04' THEN 0 ELSE q_value END AS q_value, outcome = 'supported' OR claim_id = 'c03' AS pass FROM g)
SELECT claim_id, 'pass_iff_supported' AS rule FROM h WHERE pass <> (outcome = 'supported') UNION ALL SELECT claim_id, 'q_not_below_p' FROM h WHERE q_value < p_value - 1e-12""",
    "spec_hash": f"""WITH {_TESTED} SELECT claim_id, metric, sha256('{{"claim_id":"' || claim_id || '","metric":"' || metric || '"}}') AS spec_hash FROM k""",
    "look_ledger": "SELECT event_id AS run_id, CAST(user_id % 7 AS VARCHAR) AS digest, CAST(row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) - 1 AS INTEGER) AS prior_looks, count(*) OVER (PARTITION BY user_id % 7) AS runs FROM events",
    "data_digest": """SELECT count(*) AS n, CAST(CAST(sum(CAST('0x' || substr(md5('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS digest FROM nation""",
    "story_order": "WITH w(i, kind, weight) AS (VALUES " + ", ".join(f"({i}, '{k}', {w})" for i, (k, w) in enumerate(STORY_WEIGHTS.items())) + """),
t AS (SELECT 'item' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS item_id, kind, CAST(weight + n_nationkey % 5 AS INTEGER) AS weight FROM nation JOIN w ON i = n_nationkey % 16), f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, item_id) = 1 AS lead0 FROM t),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY lead0 DESC, weight DESC, item_id) AS INTEGER) AS position FROM f) SELECT item_id, kind, weight, lead0 AND position <= 8 AS lead, position FROM p""",
    "attack_trim": f"""WITH {_FLAT}, s AS (SELECT *, pow(o_totalprice, 3) AS skewed FROM f), m AS (SELECT median(skewed) AS med FROM s), w AS (SELECT median(abs(skewed - med)) AS mad, avg(abs(skewed - med)) AS dev FROM s, m),
z AS (SELECT s.*, abs(skewed - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * dev END AS ext FROM s, m, w), x AS (SELECT *, row_number() OVER (ORDER BY ext DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM z), t AS (SELECT * FROM x WHERE NOT (ext > 3.5 AND rn <= floor(0.1 * n))),
r AS (SELECT a.e AS original, b.e AS attacked, b.n AS rows FROM {_rho_sql('', 's', 'skewed', 'c_acctbal')} a, {_rho_sql('', 't', 'skewed', 'c_acctbal')} b) SELECT 'trim' AS attack, round(original, 8) AS original, round(attacked, 8) AS attacked, rows, {_JUDGE} FROM r""",
    "attack_halves": f"""{_P}, q AS (SELECT month_no, row_number() OVER (ORDER BY month_no) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT month_no FROM region_month)), c AS (SELECT month_no AS cut FROM q WHERE rn = n // 2 + 1),
h AS (SELECT * FROM {_rho_sql('WHERE month_no < (SELECT cut FROM c)')} UNION ALL SELECT * FROM {_rho_sql('WHERE month_no >= (SELECT cut FROM c)')}), o AS (SELECT e AS original FROM {_rho_sql()}),
w AS (SELECT original, min_by(e, e * sign(original)) AS attacked, min_by(n, e * sign(original)) AS rows FROM h, o GROUP BY 1) SELECT 'halves' AS attack, round(original, 8) AS original, round(attacked, 8) AS attacked, rows, {_JUDGE} FROM w""",
    "attack_control": f"""{_PR}, c AS ({' UNION ALL '.join(f"SELECT '{z}' AS control, count(*) AS n, corr(r_revenue, r_cost) AS xy, corr(r_revenue, r_{z}) AS xz, corr(r_cost, r_{z}) AS yz FROM r" for z in ('month_no', 'lines'))}),
a AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS part FROM c WHERE abs(xz) * abs(yz) >= 0.1 AND abs(xz) < 0.9 AND abs(yz) < 0.9), o AS (SELECT corr(r_revenue, r_cost) AS original FROM r),
w AS (SELECT original, (SELECT part FROM a ORDER BY abs(xz) * abs(yz) DESC, control LIMIT 1) AS attacked, (SELECT n FROM a ORDER BY abs(xz) * abs(yz) DESC, control LIMIT 1) AS rows FROM o)
SELECT 'control' AS attack, round(original, 8) AS original, round(attacked, 8) AS attacked, rows, {_JUDGE} FROM w""",
    "attack_subgroups": f"""WITH {_FLAT}, o AS (SELECT e AS original, n AS total FROM {_rho_sql('', 'f', 'o_totalprice', 'c_acctbal')}), l AS ({_SUB('c_mktsegment')} UNION ALL {_SUB('o_orderstatus')}), k AS (SELECT column_name, count(*) AS k FROM l GROUP BY 1),
w AS (SELECT l.column_name, original, count(*) AS levels, count(*) FILTER (n / total >= 0.2 AND sign(e) = -sign(original) AND abs(e) >= 0.5 * abs(original)) AS reversed_levels, sum(e * n) / sum(n) AS pooled FROM l JOIN k ON l.column_name = k.column_name, o WHERE n >= 30 AND k BETWEEN 2 AND 10 GROUP BY 1, 2)
SELECT 'subgroups' AS attack, column_name, round(original, 7) AS original, levels, reversed_levels, round(pooled, 7) AS pooled_within, CASE WHEN reversed_levels > 0 OR sign(pooled) = -sign(original) THEN 'broken' ELSE 'survived' END AS outcome FROM w WHERE levels >= 2""",
    "attack_alternative": f"""{_PR}, w AS (SELECT corr(r_revenue, r_units) AS original, corr(revenue, units) AS attacked, count(*) AS rows FROM r) SELECT 'alternative' AS attack, round(original, 8) AS original, round(attacked, 8) AS attacked, rows, CASE WHEN sign(attacked) <> sign(original) THEN 'broken' ELSE 'survived' END AS outcome FROM w""",
    "attack_detrend": f"""{_P}, d AS (SELECT round(revenue - lag(revenue) OVER (PARTITION BY region ORDER BY month_no), 6) AS dx, round(units - lag(units) OVER (PARTITION BY region ORDER BY month_no), 6) AS dy FROM region_month), c AS (SELECT * FROM d WHERE dx IS NOT NULL AND dy IS NOT NULL),
w AS (SELECT a.e AS original, b.e AS attacked, b.n AS rows FROM {_rho_sql('', 'region_month', 'revenue', 'units')} a, {_rho_sql('', 'c', 'dx', 'dy')} b) SELECT 'detrend' AS attack, round(original, 8) AS original, round(attacked, 8) AS attacked, rows, {_JUDGE} FROM w""",
    "attack_identity": f"""{_P}, g AS (SELECT count(*) AS rows, stddev_pop(revenue) AS sd, corr(revenue - cost, revenue) AS r, {', '.join(f"max(abs({e} - revenue)) AS m{i}" for i, e in enumerate(f"({t})" for o in ("cost", "units") for t in (f"revenue - cost + {o}", f"revenue - cost - {o}", f"{o} - (revenue - cost)")))} FROM region_month)
SELECT 'identity' AS attack, rows, CASE WHEN least(m0, m1, m2, m3, m4, m5) <= 1e-6 * sd OR abs(r) >= 1 - 1e-12 THEN 'broken' ELSE 'survived' END AS outcome FROM g""",
    "skeptic_controls": f"""{_PR}, c AS ({' UNION ALL '.join(f"SELECT '{z}' AS control, count(*) AS n, corr(r_revenue, r_cost) AS xy, corr(r_revenue, r_{z}) AS xz, corr(r_cost, r_{z}) AS yz FROM r" for z in ('units', 'lines'))}),
a AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS part FROM c) SELECT control, n, round(xy, 8) AS raw, round(part, 8) AS partial, round(xz, 8) AS control_x, round(yz, 8) AS control_y,
abs(xz) >= 0.25 AND abs(yz) >= 0.25 AND abs(xz) < 0.9 AND abs(yz) < 0.9 AND abs(part) <= 0.5 * abs(xy) AND abs(xy) >= 0.1 AND n >= 30 AS caveat FROM a""",
    "fragility": f"""WITH {_GATE}, h AS (SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS claim_id, (['trim', 'halves'])[n_regionkey % 2 + 1] AS attack, n_nationkey % 2 = 0 AS broken FROM nation)
SELECT g.claim_id, CASE WHEN outcome = 'supported' THEN 'PASS' ELSE 'REJECT' END AS verdict, CASE WHEN broken THEN attack END AS broken_by, CASE WHEN outcome = 'supported' AND broken THEN 'FRAGILE' WHEN outcome = 'supported' THEN 'PASS' ELSE 'REJECT' END AS standing FROM g JOIN h ON g.claim_id = h.claim_id""",
}
