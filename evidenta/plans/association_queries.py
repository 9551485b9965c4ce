"""Registered queries of effect sizes and association, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenta.operators import association as A
from evidenta.plans.exact_queries import rounded
from evidenta.plans.views import MONTH_SERIES_SQL, REGION_MONTH_SQL, SALES_SQL, month_series, region_month, sales, table


def _lines(spark, d):
    return table(spark, d, "lineitem")


def _customers(spark, d):
    return table(spark, d, "customer")


def pearson(spark, d):
    return rounded(A.pearson(_lines(spark, d), "l_quantity", "l_extendedprice"), 9)


def spearman(spark, d):
    return rounded(A.spearman(_lines(spark, d), "l_quantity", "l_extendedprice"), 9)


def outlier_divergence(spark, d):
    return rounded(A.outlier_divergence(table(spark, d, "part"), "p_size", "p_retailprice"), 9)


def cliffs_delta(spark, d):
    return rounded(A.cliffs_delta(_lines(spark, d), "l_returnflag", "l_quantity", "R"), 9)


def hedges_g(spark, d):
    return rounded(A.hedges_g(_lines(spark, d), "l_returnflag", "l_quantity", "R"), 9)


def epsilon_squared(spark, d):
    return rounded(A.kruskal(_customers(spark, d), "c_mktsegment", "c_acctbal"), 8)


def eta_squared(spark, d):
    return rounded(A.eta_squared(_customers(spark, d), "c_mktsegment", "c_acctbal").select("n", "groups", "eta_squared"), 9)


def anova_f_stat(spark, d):
    return rounded(A.anova_f(_customers(spark, d), "c_mktsegment", "c_acctbal"), 6)


def anova_with_p(spark, d):
    return rounded(A.with_p(A.anova_f(_customers(spark, d), "c_mktsegment", "c_acctbal"), "f"), 6)


def welch_t_stat(spark, d):
    return rounded(A.welch_t(_lines(spark, d), "l_linestatus", "l_extendedprice", "O"), 6)


def welch_with_p(spark, d):
    return rounded(A.with_p(A.welch_t(_lines(spark, d), "l_linestatus", "l_extendedprice", "O"), "t"), 6)


def chi_square(spark, d):
    return rounded(A.chi_square(_lines(spark, d), "l_returnflag", "l_linestatus"), 7)


def chi_square_yates(spark, d):
    t = _lines(spark, d).select((F.col("l_returnflag") == "R").alias("returned"), "l_linestatus")
    return rounded(A.chi_square(t, "returned", "l_linestatus"), 7)


def chi_square_with_p(spark, d):
    return rounded(A.with_p(A.chi_square(_lines(spark, d), "l_returnflag", "l_linestatus"), "chi2"), 6)


def cramers_v(spark, d):
    return rounded(A.chi_square(_customers(spark, d), "c_nationkey", "c_mktsegment").select("n", "table_k", "cramers_v"), 9)


def kendall_tau_b(spark, d):
    return rounded(A.kendall_tau_b(month_series(spark, d), "month_no", "total", "month_no"), 9)


def sens_slope(spark, d):
    return rounded(A.sens_slope(month_series(spark, d), "month_no", "total", "month_no"), 4)


def relative_change(spark, d):
    o = table(spark, d, "orders")
    return rounded(A.relative_change(o, "o_totalprice", F.year("o_orderdate") == 2000, F.year("o_orderdate") == 1999), 9)


def partial_rank_corr(spark, d):
    return rounded(A.partial_rank(sales(spark, d, "revenue", "cost", "units"), "revenue", "cost", "units"), 8)


def spearman_matrix(spark, d):
    return rounded(A.rank_matrix(_lines(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 9)


def scan_pairs(spark, d):
    return rounded(A.scan_pairs(region_month(spark, d), ["revenue", "cost", "units"]), 9)


def lag1_autocorr(spark, d):
    return rounded(A.lag1_autocorrelation(region_month(spark, d), "revenue", "month_no", "region"), 9)


def first_differences(spark, d):
    return rounded(A.first_differences(region_month(spark, d).select("region", "month_no", "revenue"), "revenue", "month_no", "region"), 4)


def compare_groups(spark, d):
    return rounded(A.compare_groups(_customers(spark, d), "c_mktsegment", "c_acctbal"), 4)


def claim_scatter_fit(spark, d):
    return rounded(A.fitted_line(_lines(spark, d), "l_quantity", "l_extendedprice"), 6)


def scatter_points(spark, d):
    return A.scatter_points(_customers(spark, d), "c_custkey", "c_acctbal")


def box_summary(spark, d):
    return rounded(A.box_summary(_customers(spark, d), "c_nationkey", "c_acctbal"), 4)


QUERIES = {
    f.__name__: f
    for f in (
        pearson, spearman, outlier_divergence, cliffs_delta, hedges_g, epsilon_squared, eta_squared, anova_f_stat, anova_with_p, welch_t_stat,
        welch_with_p, chi_square, chi_square_yates, chi_square_with_p, cramers_v, kendall_tau_b, sens_slope, relative_change, partial_rank_corr,
        spearman_matrix, scan_pairs, lag1_autocorr, first_differences, compare_groups, claim_scatter_fit, scatter_points, box_summary,
    )
}


def rank_sql(column: str, partition: str = "") -> str:
    p, q = (f"PARTITION BY {partition} ", f", {partition}") if partition else ("", "")
    return f"(rank() OVER ({p}ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}{q}) - 1) / 2.0)"


_LINE_RANKS = ", ".join(f"{rank_sql(c)} AS r_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def _chi(a: str, b: str, table_: str) -> str:
    return f"""WITH o AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {table_} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), ra AS (SELECT a, count(*) AS na FROM o GROUP BY 1), rb AS (SELECT b, count(*) AS nb FROM o GROUP BY 1),
k AS (SELECT a, b, count(*) AS k FROM o GROUP BY 1, 2), g AS (SELECT coalesce(k, 0) AS obs, na * nb / (SELECT count(*) FROM o) AS ex FROM ra CROSS JOIN rb LEFT JOIN k ON k.a = ra.a AND k.b = rb.b),
s AS (SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM rb) AS c, sum((obs - ex) ** 2 / ex) AS plain, sum(greatest(abs(obs - ex) - 0.5, 0) ** 2 / ex) AS yates FROM g)"""


_CHI_OUT = "SELECT n, (r - 1) * (c - 1) AS dof, round(CASE WHEN (r - 1) * (c - 1) = 1 THEN yates ELSE plain END, 7) AS chi_square, least(r, c) AS table_k, round(sqrt(plain / (n * (least(r, c) - 1))), 7) AS cramers_v FROM s"
_PAIRS = "a AS (SELECT month_no AS x, total AS y FROM month_series), p AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM a JOIN a b ON a.x < b.x)"
_PARTIAL = f"r AS (SELECT {rank_sql('CAST(revenue AS DOUBLE)')} AS rx, {rank_sql('CAST(cost AS DOUBLE)')} AS ry, {rank_sql('units')} AS rz FROM sales), c AS (SELECT count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r)"

ORACLES = {
    "pearson": "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS pearson_r FROM lineitem",
    "spearman": f"WITH r AS (SELECT {_LINE_RANKS} FROM lineitem) SELECT count(*) AS n, round(corr(r_l_quantity, r_l_extendedprice), 9) AS spearman_rho FROM r",
    "outlier_divergence": f"WITH r AS (SELECT p_size, p_retailprice, {rank_sql('p_size')} AS a, {rank_sql('p_retailprice')} AS b FROM part) SELECT round(abs(corr(p_size, p_retailprice) - corr(a, b)), 9) AS divergence FROM r",
    "cliffs_delta": f"""WITH r AS (SELECT l_returnflag = 'R' AS a, {rank_sql('l_quantity')} AS r FROM lineitem), s AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, sum(CASE WHEN a THEN r END) AS ra FROM r)
SELECT na AS n_reference, nb AS n_other, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 9) AS cliffs_delta FROM s""",
    "hedges_g": """WITH g AS (SELECT l_returnflag = 'R' AS a, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT x.n + y.n AS n, round((1 - 3 / (4 * (x.n + y.n) - 9)) * (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)), 9) AS hedges_g FROM g x, g y WHERE x.a AND NOT y.a""",
    "epsilon_squared": f"""WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS v, {rank_sql('c_acctbal')} AS r FROM customer), s AS (SELECT g, sum(r) AS sr, count(*) AS m FROM r GROUP BY 1),
t AS (SELECT sum(k ** 3 - k) AS ties FROM (SELECT count(*) AS k FROM r GROUP BY v)), h AS (SELECT sum(m) AS n, count(*) AS groups, sum(sr * sr / m) AS s FROM s),
x AS (SELECT n, groups, (12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) ** 3 - n)) AS h FROM h, t)
SELECT CAST(n AS BIGINT) AS n, groups, round(h, 8) AS kruskal_h, round(greatest(0, least(1, h / (n - 1))), 8) AS epsilon_squared FROM x""",
    "eta_squared": """WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) SELECT (SELECT count(*) FROM customer) AS n, count(*) AS groups,
round(sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) / (SELECT var_pop(c_acctbal) * count(*) FROM customer), 9) AS eta_squared FROM g""",
    "anova_f_stat": """WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY c_mktsegment), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k,
sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) AS b, sum(n * v) AS w FROM g) SELECT n, k AS groups, round((b / (k - 1)) / (w / (n - k)), 6) AS f_stat FROM s""",
    "welch_t_stat": """WITH g AS (SELECT l_linestatus = 'O' AS a, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) / count(*) AS e FROM lineitem GROUP BY 1)
SELECT round((x.m - y.m) / sqrt(x.e + y.e), 6) AS t_stat, round((x.e + y.e) ** 2 / (x.e ** 2 / (x.n - 1) + y.e ** 2 / (y.n - 1)), 6) AS dof FROM g x, g y WHERE x.a AND NOT y.a""",
    "chi_square": _chi("l_returnflag", "l_linestatus", "lineitem") + _CHI_OUT,
    "chi_square_yates": _chi("(l_returnflag = 'R')", "l_linestatus", "lineitem") + _CHI_OUT,
    "cramers_v": _chi("c_nationkey", "c_mktsegment", "customer") + "SELECT n, least(r, c) AS table_k, round(sqrt(plain / (n * (least(r, c) - 1))), 9) AS cramers_v FROM s",
    "kendall_tau_b": f"""WITH {MONTH_SERIES_SQL}, {_PAIRS}, s AS (SELECT count(*) AS pairs, sum(sign(x2 - x1) * sign(y2 - y1)) AS s, sum(abs(sign(x2 - x1))) AS nx, sum(abs(sign(y2 - y1))) AS ny FROM p)
SELECT pairs, round(s / sqrt(nx * ny), 9) AS tau_b FROM s""",
    "sens_slope": f"WITH {MONTH_SERIES_SQL}, {_PAIRS} SELECT count(*) AS pairs, round(median((y2 - y1) / (x2 - x1)), 4) AS sens_slope FROM p WHERE x2 <> x1",
    "relative_change": """WITH w AS (SELECT avg(o_totalprice) FILTER (year(o_orderdate) = 2000) AS m1, avg(o_totalprice) FILTER (year(o_orderdate) = 1999) AS m0 FROM orders) SELECT round((m1 - m0) / abs(m0), 9) AS relative_change FROM w""",
    "partial_rank_corr": f"WITH {SALES_SQL}, {_PARTIAL} SELECT n, round(xy, 8) AS raw, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS partial, round(xz, 8) AS control_x, round(yz, 8) AS control_y FROM c",
    "spearman_matrix": f"WITH r AS (SELECT {_LINE_RANKS} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(r_{a}, r_{b}), 9) AS rho FROM r"
        for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]
    ),
    "scan_pairs": f"WITH {SALES_SQL}, {REGION_MONTH_SQL}, r AS (SELECT {rank_sql('revenue')} AS r_revenue, {rank_sql('cost')} AS r_cost, {rank_sql('units')} AS r_units FROM region_month), m AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr(r_{a}, r_{b}) AS rho FROM r" for a, b in (("revenue", "cost"), ("revenue", "units"), ("cost", "units")))
    + ") SELECT a, b, n, round(rho, 9) AS rho, CAST(row_number() OVER (ORDER BY abs(rho) DESC, a, b) AS INTEGER) AS position FROM m",
    "lag1_autocorr": f"""WITH {SALES_SQL}, {REGION_MONTH_SQL}, d AS (SELECT region, month_no, revenue - avg(revenue) OVER (PARTITION BY region) AS d FROM region_month),
l AS (SELECT *, lag(d) OVER (PARTITION BY region ORDER BY month_no) AS b FROM d) SELECT region, count(*) AS n, round(sum(d * b) / sum(d * d), 9) AS lag1 FROM l GROUP BY 1""",
    "first_differences": f"WITH {SALES_SQL}, {REGION_MONTH_SQL} SELECT region, month_no, round(revenue, 4) AS revenue, round(revenue - lag(revenue) OVER (PARTITION BY region ORDER BY month_no), 4) AS difference FROM region_month",
    "compare_groups": """SELECT c_mktsegment AS g, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q75 FROM customer GROUP BY 1""",
    "claim_scatter_fit": """SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
    "scatter_points": """WITH p AS (SELECT CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y, row_number() OVER (ORDER BY c_custkey, c_acctbal) AS rn, count(*) OVER () AS n FROM customer) SELECT x, y FROM p WHERE (rn - 1) % greatest(1, CAST(ceil(n / 600) AS BIGINT)) = 0""",
    "box_summary": """WITH b AS (SELECT CAST(c_nationkey AS VARCHAR) AS g, count(*) AS n, min(c_acctbal) AS low, quantile_cont(c_acctbal, 0.25) AS q25, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.75) AS q75, max(c_acctbal) AS high FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS rn FROM b) SELECT g, n, round(low, 4) AS low, round(q25, 4) AS q25, round(med, 4) AS median, round(q75, 4) AS q75, round(high, 4) AS high FROM r WHERE rn <= 12""",
}
