"""Registered queries of statements, evaluation, lessons, series, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenta.operators import evaluation as V
from evidenta.operators import models as M
from evidenta.operators import prepare as P
from evidenta.operators import series as T
from evidenta.operators import statements as X
from evidenta.operators.resampling import spread_rank_test
from evidenta.plans.exact_queries import rounded
from evidenta.plans.views import REGION_MONTH_SQL, SALES_SQL, WHOLE_SQL, region_month, sales, table, whole_months
from evidenta.streaming import events as W


def check_change(spark, d):
    return rounded(X.check_change(sales(spark, d, "order_date", "revenue"), "order_date", "revenue", "Q2 2000", 3.0), 6)


def check_change_year(spark, d):
    return rounded(X.check_change(sales(spark, d, "order_date", "revenue"), "order_date", "revenue", "FY2000", 0.1), 6)


def check_share(spark, d):
    return rounded(X.check_share(sales(spark, d, "region", "revenue"), "region", "revenue", "asia", 20.0), 6)


def check_rank(spark, d):
    return X.check_rank(sales(spark, d, "region", "revenue"), "region", "revenue", "europe", 1)


def rank_board(spark, d):
    return rounded(X.rank_board(sales(spark, d, "nation", "revenue"), "nation", "revenue"), 4)


def linked_proofs(spark, d):
    n = table(spark, d, "nation")
    kind = F.element_at(F.array(F.lit("association"), F.lit("causal")), (F.col("n_nationkey") % 2 + 1).cast("int"))
    statements = n.select(F.col("n_name").alias("text"), kind.alias("kind"), F.concat(F.lit("r"), (F.col("n_regionkey") + F.when(F.col("n_nationkey") % 3 == 0, 100).otherwise(0)).cast("string")).alias("var_x"), F.lit("a").alias("var_y"))
    proofs = table(spark, d, "region").select(F.lit("a").alias("var_a"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("var_b"), F.col("r_name").alias("claim_id"), F.lit("PASS").alias("verdict"))
    return X.linked_proofs(statements, proofs).select("text", "kind", "claim_id", "result")


def _truth(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("dataset"), F.concat(F.lit("a"), k.cast("string")).alias("var_a"), F.lit("z").alias("var_b"),
        F.when(k % 3 == 0, "group_difference").otherwise("correlation").alias("claim_type"), F.when(k % 4 > 0, "injected").otherwise("null").alias("label"),
        F.when(k % 2 == 0, "positive").otherwise("negative").alias("direction"), F.when(k % 3 == 0, "g1").alias("reference_group"), F.element_at(F.array(F.lit("low"), F.lit("high")), (k % 2 + 1).cast("int")).alias("level"),
    )


def _claims(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    seen = F.concat(F.lit("a"), (k + F.when(k % 5 == 2, 100).otherwise(0)).cast("string"))  # a fifth of the claims name no planted pair
    return n.select(
        F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("dataset"), F.lit("z").alias("var_a"), seen.alias("var_b"),
        F.when(k % 3 == 0, "group_difference").otherwise("correlation").alias("claim_type"), F.when(k % 7 == 0, "positive").otherwise(F.when(k % 2 == 0, "positive").otherwise("negative")).alias("direction"),
        F.when(k % 3 == 0, F.when(k % 6 == 0, "g1").otherwise("g2")).alias("reference_group"),
    )


def match_truth(spark, d):
    return V.match_truth(_claims(spark, d), _truth(spark, d)).select("dataset", "var_b", "claim_type", "is_true")


def score_claims(spark, d):
    return rounded(V.score(V.match_truth(_claims(spark, d), _truth(spark, d)), _truth(spark, d)), 9)


def aggregate_scores(spark, d):
    return rounded(V.pooled(V.score(V.match_truth(_claims(spark, d), _truth(spark, d)), _truth(spark, d))), 9)


def recall_by_level(spark, d):
    return rounded(V.recall_by_level(V.match_truth(_claims(spark, d), _truth(spark, d)), _truth(spark, d)), 9)


def schema_fingerprint(spark, d):
    return V.schema_fingerprint(P.column_roles(table(spark, d, "customer")))


def lesson_topk(spark, d):
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 3").first()["embedding"]
    store = e.select(F.col("vec_id").alias("record_id"), "embedding", "label")
    return rounded(V.lesson_search(store, query, F.col("record_id") == 3, least=-1.0), 6)


def lesson_browse(spark, d):
    return V.browse(table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), "label"), 2, 20)


def lesson_upsert(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").cast("int").alias("label"))
    return V.upsert(e.where("record_id % 3 > 0"), e.where("record_id % 2 = 0").withColumn("label", F.lit(-1)))


def trend_differenced(spark, d):
    return rounded(T.trend_tests(region_month(spark, d), "region", "month_no", "revenue"), 9)


def corr_differenced(spark, d):
    return rounded(T.correlation_tests(region_month(spark, d), "region", "month_no", "revenue", "units"), 9)


def seasonality_test(spark, d):
    return rounded(T.seasonality_tests(region_month(spark, d), "region", "month_no", "revenue"), 9)


def forecast_backtest(spark, d):
    return rounded(T.backtests(whole_months(region_month(spark, d), spark, d), "region", "month_no", "revenue"), 6)


def forecast_naive_backtest(spark, d):
    """The baseline as DataFrame operations: mean absolute error of last year's value over the last six origins."""
    s = whole_months(region_month(spark, d), spark, d).select("region", "month_no", "revenue")
    back = s.select("region", (F.col("month_no") + 12).alias("month_no"), F.col("revenue").alias("forecast"))
    joined = s.join(back, ["region", "month_no"]).select("region", "month_no", F.abs(F.col("revenue") - F.col("forecast")).alias("error"))
    latest = s.agg(F.max("month_no")).scalar()
    last = joined.where(F.col("month_no") > latest - 6)
    return rounded(last.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mae")), 4)


def forecast_loss_test(spark, d):
    return rounded(T.loss_tests(whole_months(region_month(spark, d), spark, d), "region", "month_no", "revenue"), 9)


def forecast_checks(spark, d):
    return T.checks(whole_months(region_month(spark, d), spark, d), "region", "month_no", "revenue")


def interval_coverage(spark, d):
    return rounded(T.coverages(whole_months(region_month(spark, d), spark, d), "region", "month_no", "revenue"), 9)


def perm_fast(spark, d):
    return spread_rank_test(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey")


def driver_regression(spark, d):
    p = region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month"))
    return rounded(M.driver_regression(p, "revenue", ["units", "lines"], ["region"], "cell"), 6)


def driver_importance(spark, d):
    p = region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month"))
    return rounded(M.driver_importance(p, "revenue", ["units", "lines"], ["region"], "cell"), 6)


def driver_classification(spark, d):
    p = region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month")).withColumn("large", F.when(F.col("units") > 700, "yes").otherwise("no"))
    return rounded(M.driver_classification(p, "large", ["revenue", "cost"], ["region"], "cell"), 6)


def leakage_lint(spark, d):
    p = region_month(spark, d).withColumn("profit", F.col("revenue") - F.col("cost")).withColumn("scaled", F.col("revenue") * 2 + 5)
    return rounded(M.leakage_lint(p, "revenue", ["cost", "units", "profit", "scaled"]), 6)


def leakage_proxies(spark, d):
    p = region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month"))
    return rounded(M.proxies(p, "revenue", ["units", "month_no"], "cell"), 6)


def adjusted_association(spark, d):
    p = region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month"))
    return rounded(M.adjusted_association(p, "units", "revenue", ["month_no"], "cell"), 6)


def segments(spark, d):
    return rounded(M.segments(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], "c_custkey"), 6)


def adjusted_rand(spark, d):
    return rounded(M.adjusted_rand(table(spark, d, "customer"), "c_mktsegment", "c_nationkey"), 9)


def anomalies(spark, d):
    return M.anomalies(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], "c_custkey")


def components(spark, d):
    p = region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month"))
    return rounded(M.components(p, ["revenue", "cost", "units", "lines"], row_id="cell"), 6)


def threshold_fit(spark, d):
    return rounded(M.threshold_fit(region_month(spark, d).withColumn("cell", F.concat_ws("-", "region", "month")), "units", "revenue", "cell"), 6)


def fold_sizes(spark, d):
    return table(spark, d, "orders").groupBy(M.fold_of(F.col("o_orderkey")).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


def stream_windows(spark, d):
    w = W.window_totals(table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, d):
    s = W.sessions(table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("most"), F.sum("n").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        check_change, check_change_year, check_share, check_rank, rank_board, linked_proofs, match_truth, score_claims, aggregate_scores, recall_by_level,
        schema_fingerprint, lesson_topk, lesson_browse, lesson_upsert, trend_differenced, corr_differenced, seasonality_test, forecast_backtest,
        forecast_naive_backtest, forecast_loss_test, forecast_checks, interval_coverage, perm_fast, driver_regression, driver_importance, driver_classification, leakage_lint,
        leakage_proxies, adjusted_association, segments, adjusted_rand, anomalies, components, threshold_fit, fold_sizes, stream_windows, stream_sessions,
    )
}


def _change(now: str, prev: str, year: str, key: str, claimed: float, part: str) -> str:
    total = lambda k: f"CAST(sum(CASE WHEN {part} = '{k}' THEN revenue END) AS DOUBLE)"
    return f"""WITH {SALES_SQL}, t AS (SELECT {total(now)} AS n, {total(prev)} AS p, {total(year)} AS y FROM sales), c AS (SELECT 100.0 * (n - p) / p AS cp, 100.0 * (n - y) / y AS cy FROM t)
SELECT '{key}' AS period, round(cp, 6) AS change_previous, round(cy, 6) AS change_year, CASE WHEN cp IS NULL AND cy IS NULL THEN 'cannot_check' WHEN abs(cp - {claimed}) <= 0.5 THEN 'matches' WHEN abs(cy - {claimed}) <= 0.5 THEN 'ambiguous' ELSE 'off_by' END AS result FROM c"""


_TRUTH = """tr AS (SELECT 'd' || n_regionkey AS dataset, 'a' || n_nationkey AS v, CASE WHEN n_nationkey % 3 = 0 THEN 'group_difference' ELSE 'correlation' END AS claim_type, n_nationkey % 4 > 0 AS inj, CASE WHEN n_nationkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS td,
  CASE WHEN n_nationkey % 3 = 0 THEN 'g1' END AS tref, CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE 'high' END AS level FROM nation),
cl AS (SELECT 'd' || n_regionkey AS dataset, 'a' || (n_nationkey + CASE WHEN n_nationkey % 5 = 2 THEN 100 ELSE 0 END) AS v, CASE WHEN n_nationkey % 3 = 0 THEN 'group_difference' ELSE 'correlation' END AS claim_type, CASE WHEN n_nationkey % 7 = 0 OR n_nationkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 6 = 0 THEN 'g1' ELSE 'g2' END END AS ref FROM nation),
mt AS (SELECT cl.dataset, cl.v, cl.claim_type, level, coalesce(inj AND (CASE WHEN cl.claim_type = 'group_difference' AND ref <> tref THEN CASE direction WHEN 'positive' THEN 'negative' ELSE 'positive' END ELSE direction END) = td, false) AS is_true
  FROM cl LEFT JOIN tr ON cl.dataset = tr.dataset AND cl.v = tr.v AND cl.claim_type = tr.claim_type),
sc AS (SELECT d.dataset, coalesce(reported, 0) AS reported, coalesce(hits, 0) AS true_reports, coalesce(planted, 0) AS planted FROM (SELECT DISTINCT dataset FROM tr) d
  LEFT JOIN (SELECT dataset, count(*) AS reported, count(*) FILTER (is_true) AS hits FROM mt GROUP BY 1) m ON m.dataset = d.dataset LEFT JOIN (SELECT dataset, count(*) AS planted FROM tr WHERE inj GROUP BY 1) p ON p.dataset = d.dataset)"""
def _lint_sql(target: str, features: list[str]) -> str:
    """Lines, identities and near-unique integers of every feature and pair, each from its own figures."""
    close = lambda e: f"avg(CAST(abs({e} - {target}) <= 1e-3 + 1e-3 * abs({target}) AS INTEGER))"
    cells = [f"SELECT '{c}' AS feature, 'line' AS kind, {close(f's_{c} * {c} + t_{c}')} AS value FROM p, k" for c in features]
    cells += [f"SELECT '{c}', 'unique_id', CASE WHEN bool_and({c} % 1 = 0) THEN count(DISTINCT {c}) / count({c}) ELSE 0 END FROM p" for c in features]
    cells += [f"SELECT '{c} {sign} {o}', 'identity', {close(f'({c} {sign} {o})')} FROM p" for c in features for o in features for sign in "+-" if (c < o if sign == "+" else c != o)]
    fits = ", ".join(f"regr_slope({target}, {c}) AS s_{c}, regr_intercept({target}, {c}) AS t_{c}" for c in features)
    return f"{_PROFIT}, k AS (SELECT {fits} FROM p), c AS ({' UNION ALL '.join(cells)}) SELECT feature, kind, round(CAST(value AS DOUBLE), 6) AS value FROM c WHERE value >= CASE WHEN kind = 'unique_id' THEN 0.98 ELSE 0.99 END"


_PROFIT = f"""WITH {SALES_SQL}, {REGION_MONTH_SQL}, p AS (SELECT *, revenue - cost AS profit, revenue * 2 + 5 AS scaled FROM region_month)"""

ORACLES = {
    "check_change": _change("2000Q2", "2000Q1", "1999Q2", "2000Q2", 3.0, "(year(order_date) || 'Q' || quarter(order_date))"),
    "check_change_year": _change("2000", "1999", "1999", "2000", 0.1, "strftime(order_date, '%Y')"),
    "check_share": f"WITH {SALES_SQL}, s AS (SELECT 100.0 * CAST(sum(CASE WHEN lower(region) = 'asia' THEN revenue END) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) AS share FROM sales) SELECT 'asia' AS segment, round(share, 6) AS share, CASE WHEN share IS NULL THEN 'cannot_check' WHEN abs(share - 20) <= 0.5 THEN 'matches' ELSE 'off_by' END AS result FROM s",
    "check_rank": f"WITH {SALES_SQL}, t AS (SELECT region, rank() OVER (ORDER BY sum(revenue) DESC) AS p FROM sales GROUP BY 1) SELECT region AS segment, CAST(p AS INTEGER) AS position, CASE WHEN p = 1 THEN 'matches' ELSE 'off_by' END AS result FROM t WHERE lower(region) = 'europe'",
    "rank_board": f"WITH {SALES_SQL}, t AS (SELECT nation AS segment, CAST(sum(revenue) AS DOUBLE) AS total, CAST(rank() OVER (ORDER BY sum(revenue) DESC) AS INTEGER) AS position, count(*) OVER () AS segments FROM sales GROUP BY 1) SELECT segment, round(total, 4) AS total, position, segments FROM t WHERE position <= 5",
    "linked_proofs": """WITH s AS (SELECT n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'association' ELSE 'causal' END AS kind, 'r' || (n_regionkey + CASE WHEN n_nationkey % 3 = 0 THEN 100 ELSE 0 END) AS v FROM nation)
SELECT text, kind, r_name AS claim_id, CASE WHEN kind = 'causal' THEN 'not_testable' WHEN r_name IS NULL THEN 'not_tested' ELSE 'PASS' END AS result FROM s LEFT JOIN region ON v = 'r' || r_regionkey""",
    "match_truth": f"WITH {_TRUTH} SELECT dataset, v AS var_b, claim_type, is_true FROM mt",
    "score_claims": f"WITH {_TRUTH} SELECT dataset, reported, true_reports, planted, round(CASE WHEN reported > 0 THEN true_reports / reported END, 9) AS precision, round(CASE WHEN planted > 0 THEN true_reports / planted END, 9) AS recall, round(CASE WHEN reported > 0 THEN 1 - true_reports / reported ELSE 0 END, 9) AS fdp FROM sc",
    "aggregate_scores": f"WITH {_TRUTH} SELECT count(*) AS datasets, round(sum(true_reports) / sum(reported), 9) AS precision, round(sum(true_reports) / sum(planted), 9) AS recall, round(avg(CASE WHEN reported > 0 THEN 1 - true_reports / reported ELSE 0 END), 9) AS mean_fdp FROM sc",
    "recall_by_level": f"WITH {_TRUTH} SELECT p.level, planted, coalesce(hit, 0) AS hit, round(coalesce(hit, 0) / planted, 9) AS recall FROM (SELECT level, count(*) AS planted FROM tr WHERE inj GROUP BY 1) p LEFT JOIN (SELECT level, count(*) AS hit FROM mt WHERE is_true GROUP BY 1) h ON h.level = p.level",
    "lesson_topk": """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id AS record_id, label, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS s FROM embeddings, q WHERE vec_id <> 3)
SELECT record_id, label, round(s, 6) AS similarity FROM s ORDER BY s DESC, record_id LIMIT 5""",
    "lesson_browse": "SELECT vec_id AS record_id, label FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 40",
    "lesson_upsert": "SELECT vec_id AS record_id, label FROM embeddings WHERE vec_id % 3 > 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 = 0",
    "forecast_naive_backtest": f"""WITH {SALES_SQL}, {WHOLE_SQL}, p AS (SELECT region, month_no, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales, last_month WHERE NOT (incomplete AND month_no = cut_month) GROUP BY 1, 2)
SELECT a.region, count(*) AS n, round(avg(abs(a.revenue - b.revenue)), 4) AS mae FROM p a JOIN p b ON a.region = b.region AND a.month_no = b.month_no + 12 WHERE a.month_no > (SELECT max(month_no) FROM p) - 6 GROUP BY 1""",
    "leakage_lint": _lint_sql("revenue", ["cost", "units", "profit", "scaled"]),
    "adjusted_rand": """WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS bth, CAST(sum(n) AS BIGINT) AS total FROM c), l AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), r AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT total, round((bth - x * y / (total * (total - 1) / 2)) / ((x + y) / 2 - x * y / (total * (total - 1) / 2)), 9) AS ari FROM s, l, r""",
    "fold_sizes": "SELECT CAST(CAST('0x' || substr(md5('20260817:' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n FROM orders GROUP BY 1",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH l AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events), s AS (SELECT user_id, sum(CASE WHEN g IS NULL OR g >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l),
c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS most, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY 1""",
}
