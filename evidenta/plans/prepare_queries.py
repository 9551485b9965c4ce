"""Registered queries of cleaning, profiling, roles, shape and rollups, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenta.functions.scalars import PERIOD_KEYS
from evidenta.operators import prepare as P
from evidenta.plans.exact_queries import rounded
from evidenta.plans.views import SALES_SQL, sales, sales_periods, table


def _lines(spark, d):
    return table(spark, d, "lineitem")


def clean_duplicates(spark, d):
    return P.duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


def ingest_metadata(spark, d):
    return P.ingest_metadata(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")).drop("type")


def inconsistent_labels(spark, d):
    o = table(spark, d, "orders")
    odd = F.when(F.col("o_custkey") % 10 == 0, F.lower("o_orderpriority")).when(F.col("o_custkey") % 10 == 1, F.concat(F.lit(" "), F.col("o_orderpriority")))
    return P.inconsistent_labels(o.select(F.coalesce(odd, F.col("o_orderpriority")).alias("priority")), "priority")


def dominant_ratio(spark, d):
    return rounded(P.dominant_ratio(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")), 9)


def cardinality(spark, d):
    return rounded(P.cardinality(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")), 9)


def range_violations(spark, d):
    return P.range_violations(_lines(spark, d), {"l_quantity": (5, 45), "l_discount": (None, 0.09), "l_tax": (0, None)})


def text_to_numbers(spark, d):
    t = table(spark, d, "customer").select(F.col("c_acctbal").cast("string").alias("balance"), F.col("c_mktsegment").alias("segment"))
    cleaned = P.text_to_numbers(P.markers_to_null(t))
    kinds = dict(cleaned.dtypes)
    return cleaned.agg(F.count("balance").alias("n"), F.round(F.sum(F.col("balance").cast("decimal(18,2)")).cast("double"), 2).alias("total")).withColumn(
        "balance_is_number", F.lit(kinds["balance"] == "double")
    ).withColumn("segment_is_number", F.lit(kinds["segment"] == "double"))


def profile_numeric(spark, d):
    return rounded(P.numeric_profile(_lines(spark, d), ["l_quantity", "l_discount", "l_tax"]), 6)


def profile_categorical(spark, d):
    return P.top_levels(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def column_roles(spark, d):
    return P.column_roles(table(spark, d, "customer"))


def table_shape(spark, d):
    return P.table_shape(sales(spark, d, "order_date", "region"), "order_date", "region")


def full_cycles(spark, d):
    return P.full_cycles(sales_periods(spark, d), "month_no")


def period_keys(spark, d):
    t = table(spark, d, "orders")
    return t.select("o_orderkey", *[f(F.col("o_orderdate")).alias(n) for n, f in PERIOD_KEYS.items()])


def column_brief(spark, d):
    t = table(spark, d, "orders").withColumn("coded", F.when(F.col("o_custkey") % 40 == 0, 9999.0).otherwise((F.col("o_custkey") % 50).cast("double")))
    gappy = t.withColumn("gappy", F.when(F.col("o_custkey") % 5 != 0, F.pow(F.col("o_custkey") % 100, F.lit(6)).cast("double")))
    return P.column_brief(gappy, ["o_totalprice", "coded", "gappy"])


def rollup_panel(spark, d):
    s = sales(spark, d).withColumn("discount", F.col("discount").cast("double"))
    return rounded(P.rollup(s, "month", "region", ["revenue", "units"], ["discount"], ["nation"]), 9)


def histogram(spark, d):
    return rounded(P.histogram(table(spark, d, "orders"), "o_totalprice"), 4)


def missingness(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("value") >= 10, F.col("value")).alias("value"))
    return rounded(P.missingness(e), 9)


def seeded_sample(spark, d):
    return P.seeded_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey"), 200, 42)


def imputed_scaled(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    return rounded(P.z_scaled(P.imputed(t, ["balance"], ["segment"]), ["balance"]), 6)


def keep_levels(spark, d):
    return P.keep_levels(table(spark, d, "supplier"), "s_nationkey", rows=4, levels=(2, 25)).select("s_suppkey", "s_nationkey")


QUERIES = {
    f.__name__: f
    for f in (
        clean_duplicates, ingest_metadata, inconsistent_labels, dominant_ratio, cardinality, range_violations, text_to_numbers, profile_numeric,
        profile_categorical, column_roles, table_shape, full_cycles, period_keys, column_brief, rollup_panel, histogram, missingness,
        seeded_sample, imputed_scaled, keep_levels,
    )
}


def _roles_sql(table_: str, columns: dict[str, str]) -> str:
    """The roles from counts: names are words between underscores, and none of these tables has a time or boolean column."""
    facts = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {kind == "number"} AS numeric, count({c}) AS n, count(DISTINCT {c}) AS d,
  {f"bool_and(TRY_CAST({c} AS DOUBLE) % 1 = 0)" if kind == "number" else "false"} AS integral, {f"count(TRY_CAST({c} AS DOUBLE))" if kind == "text" else "0"} AS numbers,
  {f"count(CASE WHEN year(TRY_CAST({c} AS TIMESTAMP)) BETWEEN 1800 AND 2200 THEN 1 END)" if kind == "text" else "0"} AS dates,
  len(list_intersect(string_split('{c}', '_'), ['id', 'identifier', 'index', 'key', 'uuid', 'guid', 'seqn', 'serial', 'code', 'no'])) > 0 AS named FROM {table_}"""
        for c, kind in columns.items()
    )
    return f"""WITH f AS ({facts}), r AS (SELECT *, CASE WHEN n < 20 OR d < 2 THEN 'unknown' WHEN numeric OR numbers = n THEN CASE WHEN integral AND named AND d / n >= 0.95 THEN 'id_like' WHEN integral AND d <= 12 THEN 'ordinal' ELSE 'numeric' END
  WHEN dates / n >= 0.9 THEN 'datetime' WHEN d / n >= 0.95 THEN CASE WHEN named THEN 'id_like' ELSE 'unsure' END WHEN d <= 20 THEN 'categorical' ELSE 'unsure' END AS found FROM f)
SELECT column_name, CASE WHEN found = 'unsure' THEN 'unknown' ELSE found END AS role, CASE found WHEN 'unknown' THEN 0.0 WHEN 'unsure' THEN 0.5 WHEN 'ordinal' THEN 0.8 WHEN 'datetime' THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence,
  n, d AS distinct, found = 'datetime' AS time_like FROM r"""


def _per(columns: list[str], table_: str, body: str) -> str:
    return " UNION ALL ".join("SELECT " + body.format(c=c) + f" FROM {table_}" for c in columns)


_PROFILE = (
    "'{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS std, "
    "round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(skewness({c}), 6) AS skew, round(quantile_cont({c}, 0.25), 6) AS q25, "
    "round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75"
)

ORACLES = {
    "clean_duplicates": """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem) SELECT count(*) AS rows,
(SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates FROM t""",
    "ingest_metadata": _per(["c_custkey", "c_nationkey", "c_mktsegment", "c_name"], "customer", "'{c}' AS column_name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct"),
    "inconsistent_labels": """WITH t AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN lower(o_orderpriority) WHEN o_custkey % 10 = 1 THEN ' ' || o_orderpriority ELSE o_orderpriority END AS p FROM orders),
s AS (SELECT lower(trim(p)) AS label, p, count(*) AS n FROM t GROUP BY 1, 2)
SELECT label, string_agg(p, '|' ORDER BY p) AS spellings, count(*) AS variants, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1 HAVING count(*) > 1""",
    "dominant_ratio": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(max(n) / sum(n), 9) AS ratio, max(n) / sum(n) >= 0.99 AS near_constant FROM (SELECT count(*) AS n FROM orders GROUP BY {c})"
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    ),
    "cardinality": _per(
        ["c_custkey", "c_nationkey", "c_mktsegment"], "customer",
        "'{c}' AS column_name, count(DISTINCT {c}) AS distinct, count(*) AS n, round(count(DISTINCT {c}) / count(*), 9) AS ratio, count(DISTINCT {c}) / count(*) > 0.5 AS high_cardinality, count(DISTINCT {c}) / count(*) >= 0.95 AS identifier_like",
    ),
    "range_violations": """SELECT 'l_quantity' AS column_name, count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS violations FROM lineitem
UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount > 0.09) FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0) FROM lineitem""",
    "text_to_numbers": "SELECT count(c_acctbal) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, true AS balance_is_number, false AS segment_is_number FROM customer",
    "profile_numeric": _per(["l_quantity", "l_discount", "l_tax"], "lineitem", _PROFILE),
    "profile_categorical": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS position FROM orders GROUP BY {c}) WHERE position <= 20"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
    "table_shape": f"""WITH {SALES_SQL}, c AS (SELECT month, region, count(*) AS n FROM sales GROUP BY 1, 2), p AS (SELECT month, sum(n) AS n, max(n) AS m FROM c GROUP BY 1)
SELECT CASE WHEN max(n) <= 1 THEN 'time_series' WHEN max(m) <= 1 THEN 'panel' ELSE 'transactions' END AS shape, 'month' AS period, count(*) AS periods, CAST(max(n) AS BIGINT) AS most_per_period, max(m) AS most_per_cell FROM p""",
    "full_cycles": f"WITH {SALES_SQL}, y AS (SELECT month_no // 12 AS y, count(DISTINCT month_no) AS n FROM sales GROUP BY 1) SELECT count(*) FILTER (n = 12) AS full_cycles FROM y",
    "period_keys": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' || strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y') AS year FROM orders""",
    "column_brief": """WITH t AS (SELECT o_totalprice, CASE WHEN o_custkey % 40 = 0 THEN 9999.0 ELSE CAST(o_custkey % 50 AS DOUBLE) END AS coded, CASE WHEN o_custkey % 5 <> 0 THEN pow(o_custkey % 100, 6) END AS gappy FROM orders),
f AS (SELECT 'o_totalprice' AS c, o_totalprice AS v FROM t UNION ALL SELECT 'coded', coded FROM t UNION ALL SELECT 'gappy', gappy FROM t),
p AS (SELECT c, count(v) AS n, count(*) - count(v) AS missing, skewness(v) AS skew, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM f GROUP BY 1),
o AS (SELECT f.c, count(*) AS rows, max(n) AS n FROM f JOIN p ON f.c = p.c WHERE q3 > q1 AND (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) GROUP BY 1),
s AS (SELECT c, count(*) AS n, count(*) FILTER (v = 9999) AS k, max(CASE WHEN v <> 9999 THEN v END) AS hi, min(CASE WHEN v <> 9999 THEN v END) AS lo FROM f WHERE v IS NOT NULL GROUP BY 1)
SELECT c AS column_name, 'outliers' AS kind, rows FROM o WHERE n >= 30 AND (rows >= 3 OR rows / n >= 0.005)
UNION ALL SELECT c, 'skewed', n FROM p WHERE n >= 30 AND abs(skew) >= 2
UNION ALL SELECT c, CASE WHEN missing / (n + missing) >= 0.2 THEN 'high_missing' ELSE 'some_missing' END, missing FROM p WHERE missing / (n + missing) >= 0.05
UNION ALL SELECT c, 'possible_missing_code', k FROM s WHERE k >= 3 AND k / n >= 0.01 AND n - k >= 20 AND 9999 > hi + greatest(1, 0.25 * (hi - lo))""",
    "rollup_panel": f"""WITH {SALES_SQL} SELECT month, region, round(CAST(sum(revenue) AS DOUBLE), 9) AS revenue, round(CAST(sum(CAST(units AS DECIMAL(18,4))) AS DOUBLE), 9) AS units,
round(avg(discount), 9) AS discount, CASE WHEN min(nation) = max(nation) THEN min(nation) END AS nation, count(*) AS lines FROM sales GROUP BY 1, 2""",
    "histogram": """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(12, count(DISTINCT o_totalprice)) AS bins FROM orders),
b AS (SELECT least(bins, CAST(floor((o_totalprice - lo) / ((hi - lo) / bins)) AS INTEGER) + 1) AS bin, lo, hi, bins FROM orders, e)
SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / bins), 4) AS low, round(lo + bin * ((hi - lo) / bins), 4) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi, bins""",
    "missingness": """WITH e AS (SELECT user_id, CASE WHEN value >= 10 THEN value END AS value FROM events)
SELECT 'user_id' AS column_name, count(*) AS rows, count(*) - count(user_id) AS missing, round((count(*) - count(user_id)) / count(*), 9) AS share FROM e
UNION ALL SELECT 'value', count(*), count(*) - count(value), round((count(*) - count(value)) / count(*), 9) FROM e""",
    "seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 200",
    "imputed_scaled": """WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer),
i AS (SELECT c_custkey, coalesce(balance, (SELECT median(balance) FROM t)) AS b, coalesce(segment, (SELECT segment FROM t WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM t)
SELECT c_custkey, round((b - (SELECT avg(b) FROM i)) / (SELECT stddev_pop(b) FROM i), 6) AS balance, segment FROM i""",
    "keep_levels": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 4)",
    "column_roles": _roles_sql("customer", {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}),
}
