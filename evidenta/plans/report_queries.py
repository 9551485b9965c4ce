"""Registered queries of whole reports and of claims from scan to proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenta.operators import association as A
from evidenta.operators import claims as L
from evidenta.operators import reports as R
from evidenta.operators.windows import window_pair
from evidenta.plans import exact_queries
from evidenta.plans.association_queries import rank_sql
from evidenta.plans.config import STORY_WEIGHTS
from evidenta.plans.exact_queries import rounded
from evidenta.plans.views import REGION_MONTH_SQL, SALES_SQL, region_month, sales, sales_periods, table

#: Analyses of the registered report; the last two need columns that the table does not have, the very last one is unknown.
REPORT = ("period_change", "margins", "variance_decomposition", "concentration", "pareto", "segment_ranking", "price_volume_mix", "segment_growth", "customer_view", "rfm", "seasonality", "weighted_means", "rates", "cash_flow")
RESAMPLES, INTERVAL_RESAMPLES = 999, 99


def _context(spark, d):
    df = sales(spark, d, "month_no", "revenue", "cost", "units", "customer_id", "region")
    return R.Context(df, ["revenue", "cost", "units"], ["region"], "month_no", "revenue", "cost", "units", "customer_id", pair=window_pair(sales_periods(spark, d)))


def exact_report(spark, d):
    return rounded(R.exact_report(_context(spark, d), list(REPORT)), 3)


def report_order(spark, d):
    return R.told(R.exact_report(_context(spark, d), list(REPORT)))


def report_summary(spark, d):
    return R.summary_lines(R.exact_report(_context(spark, d), list(REPORT)))


def _panel(spark, d):
    # One row per region and month: a panel that every claim, test and attack reads is worth keeping.
    p = region_month(spark, d).withColumn("row_id", F.concat_ws("-", "region", "month_no")).coalesce(1).persist()
    return L.Setting(p, "row_id", "panel", ["revenue", "units", "lines"], ["region"], "month", "month_no", "region", ("lines", "units"))


def claims_proposed(spark, d):
    return rounded(L.propose(_panel(spark, d)).drop("position"), 9)


def claims_planned(spark, d):
    s = _panel(spark, d)
    return L.plans(s, L.propose(s)).select("claim_id", "scheme", "period", "entity")


def claims_tested(spark, d):
    s = _panel(spark, d)
    return rounded(L.test_claims(s, L.propose(s), RESAMPLES).select("claim_id", "metric", "scheme", "effect", "p_value", "n_effective", "reason"), 9)


def claims_proved(spark, d):
    return rounded(L.prove(_panel(spark, d), RESAMPLES, INTERVAL_RESAMPLES), 7)


def quartile_strata(spark, d):
    return A.quartile_strata(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


def group_link(spark, d):
    return rounded(A.group_link(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), 9)


def seasonal_range(spark, d):
    return rounded(A.seasonal_range(table(spark, d, "orders").select("o_totalprice", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no")), "o_totalprice", "month_no"), 7)


def latest_absolute_change(spark, d):
    return rounded(A.latest_absolute_change(table(spark, d, "orders").select("o_totalprice", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no")), "o_totalprice", "month_no"), 5)


def gaps_filled(spark, d):
    days = table(spark, d, "orders").groupBy("o_orderpriority", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("day_no")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("total"))
    return rounded(A.gaps_filled(days, "total", "day_no", "o_orderpriority"), 7)


QUERIES = {
    f.__name__: f
    for f in (
        exact_report, report_order, report_summary, claims_proposed, claims_planned, claims_tested, claims_proved, quartile_strata, group_link,
        seasonal_range, latest_absolute_change, gaps_filled,
    )
}

_X = exact_queries.ORACLES


def _figures() -> list[tuple[str, str, str, str, str]]:
    """(kind, source, subject, label, value) of the report's figures, each from the registered SQL of its analysis."""
    out = [
        ("period_change", _X["period_change"], "measure", "'change'", "change"),
        ("variance_decomposition", _X["variance_decomposition"], "'region'", "segment", "change"),
        ("seasonality", _X["seasonality_calendar"], "'revenue'", "CAST(position AS VARCHAR)", "index"),
        ("rfm", _X["rfm_segments"], "'customer_id'", "rfm_segment", "money_share"),
    ]
    out += [("concentration", _X["concentration"], "'customer_id'", f"'{c}'", c) for c in ("largest_share", "top_tenth_share")]
    out += [("customer_view", _X["customer_view"], "'customer_id'", f"'{c}'", c) for c in ("top_ten_share", "top_tenth_share", "repeat_share")]
    return out


def _plain() -> dict[str, str]:
    """Analyses by region, which the registered queries run by other columns."""
    bounds = exact_queries._W
    both = f"coalesce({exact_queries._sum(exact_queries.BEFORE, 'revenue')}, 0) AS r0, coalesce({exact_queries._sum(exact_queries.NOW, 'revenue')}, 0) AS r1, coalesce({exact_queries._sum(exact_queries.BEFORE, 'units')}, 0) AS q0, coalesce({exact_queries._sum(exact_queries.NOW, 'units')}, 0) AS q1"
    cells = f"{bounds}, t AS (SELECT region, {both}, CAST(sum(revenue) AS DOUBLE) AS total FROM sales GROUP BY 1), s AS (SELECT *, r0 > 0 AND q0 > 0 AND r1 > 0 AND q1 > 0 AS ok FROM t), z AS (SELECT *, sum(CASE WHEN ok THEN q0 END) OVER () AS t0, sum(CASE WHEN ok THEN q1 END) OVER () AS t1 FROM s)"
    parts = {"volume": "CASE WHEN ok THEN (t1 * q0 / t0 - q0) * r0 / q0 END", "mix": "CASE WHEN ok THEN (q1 - t1 * q0 / t0) * r0 / q0 END", "price": "CASE WHEN ok THEN q1 * (r1 / q1 - r0 / q0) END", "other": "CASE WHEN NOT ok THEN r1 - r0 END"}
    sums = f"{exact_queries._sum(exact_queries.NOW, 'revenue')} AS r1, {exact_queries._sum(exact_queries.NOW, 'cost')} AS c1, {exact_queries._sum(exact_queries.BEFORE, 'revenue')} AS r0, {exact_queries._sum(exact_queries.BEFORE, 'cost')} AS c0"
    return {
        "pareto": f"{cells} SELECT 'region' AS subject, region AS label, sum(total) OVER (ORDER BY total DESC, region ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS value FROM z",
        "segment_ranking": f"{cells} SELECT 'region' AS subject, region AS label, total AS value FROM z",
        "segment_growth": f"{cells}, g AS (SELECT region, r1 / r0 - 1 AS value, count(*) OVER () AS n FROM (SELECT *, sum(r0) OVER () AS a0 FROM z) WHERE r0 > 0 AND r0 >= 0.02 * a0) SELECT 'region' AS subject, region AS label, value FROM g WHERE n > 1",
        "price_volume_mix": f"{cells} " + " UNION ALL ".join(f"SELECT 'region' AS subject, '{k}' AS label, coalesce(sum({e}), 0) AS value FROM z" for k, e in parts.items()),
        "margins": f"""{bounds}, t AS (SELECT '(all)' AS subject, '(all)' AS label, {sums} FROM sales UNION ALL SELECT 'region', region, {sums} FROM sales GROUP BY region), m AS (SELECT subject, label, CASE WHEN r1 > 0 THEN 100.0 * (r1 - c1) / r1 END - CASE WHEN r0 > 0 THEN 100.0 * (r0 - c0) / r0 END AS value FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY value ASC NULLS LAST, label) AS rn FROM m) SELECT subject, label, value FROM p WHERE rn <= 5""",
    }


def _report_sql(order: bool = False, lines: bool = False) -> str:
    parts = [f"SELECT '{kind}' AS kind, {subject} AS subject, CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM ({sql})" for kind, sql, subject, label, value in _figures()]
    parts += [f"SELECT '{kind}' AS kind, subject, label, CAST(value AS DOUBLE) AS value FROM ({sql})" for kind, sql in _plain().items()]
    body = f"WITH f AS ({' UNION ALL '.join(parts)})"
    if not order and not lines:
        lacking = {"weighted_means": "the table has no weight", "rates": "the table has no cases, population", "cash_flow": "no such analysis"}
        missing = " UNION ALL ".join(f"SELECT '{k}', '(none)', '(none)', NULL, 'not_run', '{why}'" for k, why in lacking.items())
        return f"{body} SELECT kind, subject, label, round(value, 3) AS value, 'ok' AS status, CAST(NULL AS VARCHAR) AS note FROM f UNION ALL {missing}"
    weights = ", ".join(f"('{k}', {w})" for k, w in STORY_WEIGHTS.items())
    leads = 6 if lines else 8
    placed = f"""{body}, w(k, w) AS (VALUES {weights}), i AS (SELECT DISTINCT kind, subject, kind || ':' || subject AS item_id, CAST(coalesce(w, 0) AS INTEGER) AS weight FROM f LEFT JOIN w ON k = kind),
l AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, item_id) = 1 AS lead0 FROM i), o AS (SELECT *, CAST(row_number() OVER (ORDER BY lead0 DESC, weight DESC, item_id) AS INTEGER) AS position FROM l)"""
    if order:
        return f"{placed} SELECT item_id, kind, subject, weight, lead0 AND position <= {leads} AS lead, position FROM o"
    return f"""{placed}, t AS (SELECT *, row_number() OVER (PARTITION BY kind, subject ORDER BY abs(value) DESC NULLS LAST, label) AS rn FROM f)
SELECT position, replace(o.kind, '_', ' ') || ' of ' || o.subject || ': ' || label || ' ' || coalesce(regexp_replace(format('{{:,.2f}}', value), '\\.00$', ''), 'n/a') AS text FROM o JOIN t ON t.kind = o.kind AND t.subject = o.subject WHERE rn = 1 AND position <= 6"""


_PANEL = ("revenue", "units", "lines")


def _claims_sql() -> str:
    """The scan of the earlier periods: rank correlations, group differences of the regions and trends of the period means."""
    pairs = " UNION ALL ".join(f"SELECT 'correlation' AS claim_type, '{a}' AS var_a, '{b}' AS var_b, corr(r_{a}, r_{b}) AS rho, abs(corr(r_{a}, r_{b})) AS magnitude, count(*) AS n FROM r" for i, a in enumerate(_PANEL) for b in _PANEL[i + 1 :])
    trends = " UNION ALL ".join(
        f"""SELECT 'trend', 'month_no', '{v}', t, abs(t), (SELECT count(*) FROM e) FROM (SELECT sum(sign(b.t - a.t) * sign(b.v - a.v)) / sqrt(sum(abs(sign(b.t - a.t))) * sum(abs(sign(b.v - a.v)))) AS t
  FROM (SELECT month_no AS t, round(avg({v}), 9) AS v FROM e GROUP BY 1) a JOIN (SELECT month_no AS t, round(avg({v}), 9) AS v FROM e GROUP BY 1) b ON a.t < b.t)"""
        for v in _PANEL
    )
    groups = " UNION ALL ".join(
        f"SELECT 'group_difference', 'region', '{v}', CAST(NULL AS DOUBLE), sum(n * (m - gm) ** 2) / max(gs), CAST(sum(n) AS BIGINT) FROM (SELECT region, count(*) AS n, avg({v}) AS m FROM e GROUP BY 1), (SELECT avg({v}) AS gm, var_pop({v}) * count(*) AS gs FROM e) HAVING count(*) BETWEEN 2 AND 10"
        for v in _PANEL
    )
    return f"""WITH {SALES_SQL}, {REGION_MONTH_SQL}, p AS (SELECT month_no, row_number() OVER (ORDER BY month_no DESC) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT month_no FROM region_month)),
cut AS (SELECT min(month_no) AS c FROM p WHERE rn <= CASE WHEN ceil(n * 0.5) < 20 AND n >= 28 THEN 20 ELSE ceil(n * 0.5) END), e AS (SELECT region_month.* FROM region_month, cut WHERE month_no < c),
r AS (SELECT *, {', '.join(f'{rank_sql(c)} AS r_{c}' for c in _PANEL)} FROM e), m AS ({pairs} UNION ALL {groups} UNION ALL {trends}),
k AS (SELECT * FROM m WHERE CASE claim_type WHEN 'correlation' THEN magnitude >= 0.15 AND n >= 30 WHEN 'trend' THEN magnitude >= 0.10 ELSE magnitude >= 0.01 AND n >= 30 END)
SELECT claim_type, var_a, var_b, round(magnitude, 9) AS magnitude, CASE WHEN rho > 0 THEN 'positive' WHEN rho < 0 THEN 'negative' END AS direction, CAST(NULL AS VARCHAR) AS reference_group, n, claim_type || ':' || var_a || ':' || var_b AS claim_id FROM k"""


_MONTH = "CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER)"
ORACLES = {
    "exact_report": _report_sql(),
    "report_order": _report_sql(order=True),
    "report_summary": _report_sql(lines=True),
    "claims_proposed": _claims_sql(),
    "quartile_strata": "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal IS NOT NULL THEN CAST(c_acctbal > a AS INTEGER) + CAST(c_acctbal > b AS INTEGER) + CAST(c_acctbal > c AS INTEGER) END AS stratum FROM customer, q",
    "group_link": f"WITH r AS (SELECT c_mktsegment AS g, {rank_sql('c_acctbal')} AS r FROM customer), g AS (SELECT g, count(*) AS n, avg(r) AS m FROM r GROUP BY 1), t AS (SELECT avg(r) AS gm, var_pop(r) * count(*) AS s, count(*) AS k FROM r) SELECT max(k) AS n, count(*) AS groups, round(sum(n * (m - gm) ** 2) / max(s), 9) AS rank_eta_squared FROM g, t",
    "seasonal_range": f"WITH m AS (SELECT CAST({_MONTH} % 12 + 1 AS INTEGER) AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT count(*) AS positions, first(p ORDER BY m DESC, p) AS peak, first(p ORDER BY m, p) AS trough, round((max(m) - min(m)) / abs(avg(m)), 7) AS seasonal_range FROM m",
    "latest_absolute_change": f"WITH m AS (SELECT {_MONTH} AS o, avg(o_totalprice) AS m FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY o DESC) AS rn FROM m) SELECT max(CASE WHEN rn = 1 THEN o END) AS latest, max(CASE WHEN rn = 2 THEN o END) AS before, round(max(CASE WHEN rn = 1 THEN m END) - max(CASE WHEN rn = 2 THEN m END), 5) AS absolute_change FROM r",
    "gaps_filled": """WITH t AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS o, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2), n AS (SELECT *, lead(o) OVER w AS o2, lead(v) OVER w AS v2 FROM t WINDOW w AS (PARTITION BY p ORDER BY o)),
s AS (SELECT *, unnest(range(o, coalesce(o2, o + 1))) AS pt FROM n) SELECT p AS o_orderpriority, pt AS day_no, round(v + coalesce(v2 - v, 0) * coalesce((pt - o) / (o2 - o), 0), 7) AS total, pt > o AS filled FROM s""",
}
