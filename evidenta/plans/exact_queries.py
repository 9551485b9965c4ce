"""Registered queries of the exact figures, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenta.operators import exact as E
from evidenta.operators.windows import window_pair
from evidenta.plans.views import MONTH_SERIES_SQL, REGION_MONTH_SQL, SALES_SQL, WINDOW_SQL, month_series, region_month, sales, sales_periods, table


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the last bits of a quotient do not matter; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pair(spark, d):
    """The two windows of ``sales``, from the months of the orders."""
    return window_pair(sales_periods(spark, d))


def period_change(spark, d):
    s = sales(spark, d, "month_no", "revenue", "cost", "units")
    return rounded(E.period_change(s, ["revenue", "cost", "units"], _pair(spark, d)))


def margins(spark, d):
    s = sales(spark, d, "month_no", "revenue", "cost", "region", "segment", "priority")
    return rounded(E.margins(s, "revenue", "cost", ["region", "segment", "priority"], _pair(spark, d)))


def variance_decomposition(spark, d):
    s = sales(spark, d, "month_no", "region", "revenue")
    return rounded(E.variance_decomposition(s, "region", "revenue", _pair(spark, d)))


def variance_with_other(spark, d):
    s = sales(spark, d, "month_no", "nation", "revenue")
    return rounded(E.variance_decomposition(s, "nation", "revenue", _pair(spark, d)))


def concentration(spark, d):
    return rounded(E.concentration(sales(spark, d, "customer_id", "revenue"), "customer_id", "revenue"), 9)


def pareto(spark, d):
    return rounded(E.pareto(sales(spark, d, "nation", "revenue"), "nation", "revenue"))


def segment_ranking(spark, d):
    return rounded(E.segment_ranking(sales(spark, d, "nation", "revenue"), "nation", "revenue"), 4)


def outliers_period(spark, d):
    return rounded(E.period_outliers(sales(spark, d, "month", "revenue"), "month", "revenue"))


def outliers_row(spark, d):
    return rounded(E.row_outliers(sales(spark, d, "order_id", "line_no", "segment", "revenue"), ["order_id", "line_no"], "segment", "revenue"))


def seasonality_calendar(spark, d):
    return rounded(E.seasonality(sales(spark, d, "month_no", "revenue"), "revenue"))


def seasonality_rolling(spark, d):
    return rounded(E.rolling_seasonality(sales(spark, d, "month_no", "revenue"), "revenue"))


def consecutive_tail(spark, d):
    return E.consecutive_tail(table(spark, d, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no")))


def incomplete_last_period(spark, d):
    return rounded(E.incomplete_last_period(month_series(spark, d)))


def caveats(spark, d):
    series = month_series(spark, d)
    return E.caveats(series.select("month", "month_no", "total"), "month_no", E.incomplete_last_period(series))


def missing_periods(spark, d):
    ships = table(spark, d, "events").where(F.col("event_type") == "purchase")
    return E.missing_periods(ships.select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day_no")), "day_no")


def identity(spark, d):
    lines = table(spark, d, "lineitem")
    gross = E.derived_discounted(F.col("l_extendedprice"), F.col("l_discount"))
    return rounded(E.identity(lines.withColumn("net", F.round(gross, 2)), "net", gross))


def data_quality(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no"))
    return E.data_quality(c, ["o_totalprice", "o_custkey"])


def prevalence(spark, d):
    return rounded(E.prevalence(table(spark, d, "customer"), "c_acctbal", ">=", 5000, by=F.col("c_mktsegment")))


def prevalence_weighted(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(E.banded_prevalence(lines, "l_discount", ">=", 0.05, "l_quantity", [1, 10, 20, 30, 40], "l_quantity"), 9)


def weighted_means(spark, d):
    return rounded(E.weighted_means(table(spark, d, "lineitem"), ["l_extendedprice", "l_discount", "l_tax"], "l_quantity"))


def rates(spark, d):
    lines = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", (F.col("l_returnflag") == "R").cast("int").alias("cases"), F.col("l_quantity").alias("people"))
    return rounded(E.rates(lines, "cases", "people", "l_linestatus"))


def price_volume_mix(spark, d):
    s = sales(spark, d, "month_no", "brand", "revenue", "units")
    return rounded(E.price_volume_mix(s, "brand", "revenue", "units", _pair(spark, d)), 3)


def segment_growth(spark, d):
    s = sales(spark, d, "month_no", "nation", "revenue")
    return rounded(E.segment_growth(s, "nation", "revenue", _pair(spark, d)))


def customer_view(spark, d):
    return rounded(E.customer_view(sales(spark, d, "customer_id", "month_no", "revenue"), "customer_id", "revenue"), 9)


def customer_new_returning(spark, d):
    s = sales(spark, d, "month_no", "customer_id", "revenue")
    return rounded(E.new_and_returning(s, "customer_id", "revenue", _pair(spark, d)), 4)


def rfm(spark, d):
    return rounded(E.rfm(sales(spark, d, "customer_id", "month_no", "revenue"), "customer_id", "revenue"), 4)


def rfm_segments(spark, d):
    return rounded(E.rfm_segments(E.rfm(sales(spark, d, "customer_id", "month_no", "revenue"), "customer_id", "revenue")), 4)


def panel_change(spark, d):
    p = region_month(spark, d)
    return rounded(E.variance_decomposition(p, "region", "units", _pair(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        period_change, margins, variance_decomposition, variance_with_other, concentration, pareto, segment_ranking, outliers_period,
        outliers_row, seasonality_calendar, seasonality_rolling, consecutive_tail, incomplete_last_period, caveats, missing_periods,
        identity, data_quality, prevalence, prevalence_weighted, weighted_means, rates, price_volume_mix, segment_growth, customer_view,
        customer_new_returning, rfm, rfm_segments, panel_change,
    )
}

_S = f"WITH {SALES_SQL}"
_W = f"WITH {SALES_SQL}, {WINDOW_SQL}"
NOW, BEFORE = "month_no BETWEEN (SELECT c0 FROM bounds) AND (SELECT c1 FROM bounds)", "month_no BETWEEN (SELECT p0 FROM bounds) AND (SELECT p1 FROM bounds)"


def _sum(cond: str, value: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN CAST({value} AS DECIMAL(18,4)) END) AS DOUBLE)"


def _change_sql(source: str, seg: str, measure: str, with_: str) -> str:
    return f"""{with_},
t AS (SELECT coalesce(CAST({seg} AS VARCHAR), '(missing)') AS segment, coalesce({_sum(BEFORE, measure)}, 0) AS previous,
  coalesce({_sum(NOW, measure)}, 0) AS current FROM {source} GROUP BY 1),
c AS (SELECT *, CAST(current AS DECIMAL(18,4)) - CAST(previous AS DECIMAL(18,4)) AS change, sum(CAST(current AS DECIMAL(18,4)) - CAST(previous AS DECIMAL(18,4))) OVER () AS total FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY change * sign(total) DESC, segment) AS rn, count(*) OVER () AS n FROM c WHERE total <> 0),
f AS (SELECT CASE WHEN n > 12 AND rn >= 12 THEN 'other' ELSE segment END AS segment, CAST(CASE WHEN n > 12 AND rn >= 12 THEN 12 ELSE rn END AS INTEGER) AS position,
  sum(previous) AS previous, sum(current) AS current, CAST(sum(change) AS DOUBLE) AS change FROM r GROUP BY 1, 2)
SELECT segment, position, round(previous, 6) AS previous, round(current, 6) AS current, round(change, 6) AS change, round(change / sum(change) OVER (), 6) AS share FROM f"""


def _period_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, {_sum(NOW, m)} AS current, {_sum(BEFORE, m)} AS previous FROM sales" for m in ("revenue", "cost", "units")
    )
    return f"""{_W}, t AS ({one}) SELECT measure, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) AS change,
round(CASE WHEN previous > 0 THEN 100.0 * (current - previous) / previous END, 6) AS percent FROM t"""


def _margins_sql() -> str:
    sums = f"{_sum(NOW, 'revenue')} AS r1, {_sum(NOW, 'cost')} AS c1, {_sum(BEFORE, 'revenue')} AS r0, {_sum(BEFORE, 'cost')} AS c0"
    cells = " UNION ALL ".join(
        [f"SELECT '(all)' AS column_name, '(all)' AS level, {sums} FROM sales"]
        + [f"SELECT '{g}', {g}, {sums} FROM sales GROUP BY {g}" for g in ("region", "segment", "priority")]
    )
    return f"""{_W}, t AS ({cells}), m AS (SELECT column_name, level, CASE WHEN r1 > 0 THEN 100.0 * (r1 - c1) / r1 END AS current,
  CASE WHEN r0 > 0 THEN 100.0 * (r0 - c0) / r0 END AS previous FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY current - previous ASC NULLS LAST, level) AS rn FROM m)
SELECT column_name, level, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) AS change, CAST(rn AS INTEGER) AS position
FROM p WHERE rn <= 5"""


_RFM_SQL = f"""{_S}, per AS (SELECT customer_id AS customer, sum(revenue) AS net, max(month_no) AS last_period, count(DISTINCT month_no) AS frequency FROM sales GROUP BY 1),
pos AS (SELECT month_no, dense_rank() OVER (ORDER BY month_no) - 1 AS pos FROM (SELECT DISTINCT month_no FROM sales)),
base AS (SELECT customer, (SELECT max(pos) FROM pos) - p.pos AS recency, frequency, CAST(net AS DOUBLE) AS money FROM per JOIN pos p ON p.month_no = last_period WHERE net > 0),
sc AS (SELECT customer, recency, frequency, money,
  CAST(ceil(5.0 * (rank() OVER (ORDER BY -recency) + (count(*) OVER (PARTITION BY recency) - 1) / 2.0) / count(*) OVER ()) AS INTEGER) AS recency_score,
  CAST(ceil(5.0 * (rank() OVER (ORDER BY frequency) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0) / count(*) OVER ()) AS INTEGER) AS frequency_score,
  CAST(ceil(5.0 * (rank() OVER (ORDER BY money) + (count(*) OVER (PARTITION BY money) - 1) / 2.0) / count(*) OVER ()) AS INTEGER) AS money_score FROM base),
seg AS (SELECT *, CASE WHEN recency_score >= 4 AND frequency_score >= 4 THEN 'Champions' WHEN frequency_score >= 4 AND recency_score >= 2 THEN 'Loyal'
  WHEN frequency_score >= 4 THEN 'Lapsed regulars' WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'Recent'
  WHEN recency_score <= 2 AND frequency_score <= 2 THEN 'Lost' ELSE 'Middle' END AS rfm_segment FROM sc)"""

ORACLES = {
    "period_change": _period_sql(),
    "margins": _margins_sql(),
    "variance_decomposition": _change_sql("sales", "region", "revenue", _W),
    "variance_with_other": _change_sql("sales", "nation", "revenue", _W),
    "panel_change": _change_sql("region_month", "region", "units", f"WITH {SALES_SQL}, {REGION_MONTH_SQL}, {WINDOW_SQL}"),
    "concentration": f"""{_S}, t AS (SELECT customer_id, sum(revenue) AS total FROM sales GROUP BY 1),
r AS (SELECT total, row_number() OVER (ORDER BY total DESC, CAST(customer_id AS VARCHAR)) AS rn, count(*) OVER () AS n FROM t)
SELECT count(*) AS segments, round(CAST(sum(total) AS DOUBLE), 9) AS total, round(CAST(max(total) AS DOUBLE) / CAST(sum(total) AS DOUBLE), 9) AS largest_share,
round(CASE WHEN count(*) >= 10 THEN CAST(sum(CASE WHEN rn <= ceil(n * 0.1) THEN total END) AS DOUBLE) / CAST(sum(total) AS DOUBLE) END, 9) AS top_tenth_share FROM r
HAVING min(total) >= 0 AND sum(total) > 0""",
    "pareto": f"""{_S}, t AS (SELECT nation AS segment, CAST(sum(revenue) AS DOUBLE) AS total FROM sales GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, segment) AS rn, count(*) OVER () AS n FROM t),
f AS (SELECT CASE WHEN n > 12 AND rn >= 12 THEN 'other' ELSE segment END AS segment, CAST(CASE WHEN n > 12 AND rn >= 12 THEN 12 ELSE rn END AS INTEGER) AS position, sum(total) AS total FROM r GROUP BY 1, 2)
SELECT segment, position, round(total, 6) AS total, round(CAST(sum(CAST(total AS DECIMAL(18,4))) OVER (ORDER BY position) AS DOUBLE) / CAST(sum(CAST(total AS DECIMAL(18,4))) OVER () AS DOUBLE), 6) AS cumulative_share FROM f""",
    "segment_ranking": f"""{_S}, t AS (SELECT nation AS segment, CAST(sum(revenue) AS DOUBLE) AS total, count(revenue) AS n FROM sales GROUP BY 1)
SELECT segment, round(total, 4) AS total, n, round(total / n, 4) AS mean, round(total / CAST(sum(CAST(total AS DECIMAL(18,4))) OVER () AS DOUBLE), 4) AS share,
CAST(row_number() OVER (ORDER BY total DESC, segment) AS INTEGER) AS position FROM t""",
    "outliers_period": f"""{_S}, t AS (SELECT month, CAST(sum(revenue) AS DOUBLE) AS total FROM sales GROUP BY 1),
a AS (SELECT *, median(total) OVER () AS med, count(*) OVER () AS n FROM t), b AS (SELECT *, abs(total - med) AS away FROM a),
c AS (SELECT *, median(away) OVER () AS mad, avg(away) OVER () AS dev FROM b),
z AS (SELECT *, (total - med) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN dev > 0 THEN 1.2533 * dev END AS z FROM c)
SELECT month, round(total, 6) AS total, round(med, 6) AS median, round(z, 6) AS z FROM z WHERE abs(z) >= 3.5 AND n >= 5""",
    "outliers_row": f"""{_S}, v AS (SELECT order_id, line_no, segment, CAST(revenue AS DOUBLE) AS value FROM sales WHERE revenue > 0),
m AS (SELECT segment, median(value) AS segment_median FROM v GROUP BY 1), l AS (SELECT v.*, segment_median, ln(value / segment_median) AS ratio FROM v JOIN m USING (segment)),
c AS (SELECT median(ratio) AS q FROM l), w AS (SELECT l.*, abs(ratio - q) AS away, q FROM l, c), s AS (SELECT median(away) AS mad, avg(away) AS dev FROM w),
z AS (SELECT w.*, (ratio - q) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * dev END AS z FROM w, s)
SELECT order_id, line_no, segment, round(value, 6) AS value, round(segment_median, 6) AS segment_median, round(z, 6) AS z FROM z WHERE abs(z) >= 3.5""",
    "seasonality_calendar": f"""{_S}, t AS (SELECT month_no // 12 AS y, month_no % 12 + 1 AS position, sum(revenue) AS total FROM sales GROUP BY 1, 2),
f AS (SELECT *, count(*) OVER (PARTITION BY y) AS n FROM t), m AS (SELECT position, CAST(sum(total) AS DOUBLE) / count(*) AS mean_total, count(*) AS years FROM f WHERE n = 12 GROUP BY 1)
SELECT CAST(position AS INTEGER) AS position, round(mean_total, 6) AS mean_total, years, round(mean_total / (CAST(sum(CAST(mean_total AS DECIMAL(18,4))) OVER () AS DOUBLE) / 12), 6) AS index FROM m""",
    "seasonality_rolling": f"""{_S}, t AS (SELECT month_no AS o, sum(revenue) AS total FROM sales GROUP BY 1), g AS (SELECT *, o - row_number() OVER (ORDER BY o) AS island FROM t),
r AS (SELECT * FROM g WHERE island = (SELECT island FROM g ORDER BY o DESC LIMIT 1)), k AS (SELECT * FROM r WHERE (SELECT count(*) FROM r) >= 24 AND (SELECT min(total) FROM r) > 0),
a AS (SELECT o, total, CASE WHEN row_number() OVER (ORDER BY o) >= 12 THEN CAST(sum(total) OVER (ORDER BY o ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS DOUBLE) / 12 END AS trail FROM k),
b AS (SELECT o, CAST(total AS DOUBLE) / ((lead(trail, 5) OVER (ORDER BY o) + lead(trail, 6) OVER (ORDER BY o)) / 2) AS ratio FROM a),
m AS (SELECT o % 12 + 1 AS position, round(avg(ratio), 10) AS raw FROM b WHERE ratio IS NOT NULL GROUP BY 1)
SELECT CAST(position AS INTEGER) AS position, round(raw / avg(raw) OVER (), 6) AS index FROM m""",
    "consecutive_tail": """WITH p AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS o FROM orders), g AS (SELECT o, o - row_number() OVER (ORDER BY o) AS island FROM p),
t AS (SELECT min(o) AS first, max(o) AS last, count(*) AS periods FROM g GROUP BY island) SELECT first, last, periods FROM t WHERE last = (SELECT max(o) FROM p)""",
    "incomplete_last_period": f"""WITH {MONTH_SERIES_SQL}, x AS (SELECT max(month_no) AS latest, count(*) AS periods FROM month_series),
f AS (SELECT latest, periods, max(CASE WHEN month_no = latest THEN n_rows END) AS last_rows, median(CASE WHEN month_no < latest THEN n_rows END) AS usual_rows,
  max(CASE WHEN month_no = latest THEN last_day END) AS last_max_day, median(CASE WHEN month_no < latest THEN last_day END) AS usual_max_day FROM month_series, x GROUP BY 1, 2)
SELECT latest, periods, last_rows, round(usual_rows, 6) AS usual_rows, CAST(last_max_day AS INTEGER) AS last_max_day, round(usual_max_day, 6) AS usual_max_day,
periods >= 4 AND (coalesce(usual_rows >= 4 AND last_rows < 0.5 * usual_rows, false) OR coalesce(usual_max_day > 1 AND last_max_day < 0.7 * usual_max_day, false)) AS incomplete FROM f""",
    "caveats": f"""WITH {MONTH_SERIES_SQL}, x AS (SELECT max(month_no) AS latest, count(*) AS periods FROM month_series),
f AS (SELECT latest, periods >= 4 AND ((median(CASE WHEN month_no < latest THEN n_rows END) >= 4 AND max(CASE WHEN month_no = latest THEN n_rows END) < 0.5 * median(CASE WHEN month_no < latest THEN n_rows END))
  OR max(CASE WHEN month_no = latest THEN last_day END) < 0.7 * median(CASE WHEN month_no < latest THEN last_day END)) AS inc FROM month_series, x GROUP BY latest, periods)
SELECT month, month_no, total, month_no = latest AND inc AS caveat FROM month_series, f""",
    "missing_periods": """WITH p AS (SELECT DISTINCT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS o FROM events WHERE event_type = 'purchase')
SELECT CAST(g AS INTEGER) AS period_no FROM (SELECT unnest(range((SELECT min(o) FROM p), (SELECT max(o) + 1 FROM p))) AS g) WHERE g NOT IN (SELECT o FROM p)""",
    "identity": """WITH x AS (SELECT round(l_extendedprice * (1 - l_discount), 2) AS r, l_extendedprice * (1 - l_discount) AS e FROM lineitem)
SELECT count(*) AS n, round(avg(CAST(abs(e - r) <= 0.001 + 0.001 * abs(r) AS INTEGER)), 6) AS share, count(*) >= 10 AND avg(CAST(abs(e - r) <= 0.001 + 0.001 * abs(r) AS INTEGER)) >= 0.99 AS reported FROM x""",
    "data_quality": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no FROM orders)
SELECT 'duplicate_rows' AS issue, '(all)' AS column_name, (SELECT count(*) FROM o) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o)) AS count
UNION ALL SELECT 'negative', 'o_totalprice', count(*) FILTER (o_totalprice < 0) FROM o UNION ALL SELECT 'negative', 'o_custkey', count(*) FILTER (o_custkey < 0) FROM o
UNION ALL SELECT 'constant', 'o_orderkey', CAST(min(o_orderkey) = max(o_orderkey) AS BIGINT) FROM o UNION ALL SELECT 'constant', 'o_custkey', CAST(min(o_custkey) = max(o_custkey) AS BIGINT) FROM o
UNION ALL SELECT 'constant', 'o_orderstatus', CAST(min(o_orderstatus) = max(o_orderstatus) AS BIGINT) FROM o UNION ALL SELECT 'constant', 'o_totalprice', CAST(min(o_totalprice) = max(o_totalprice) AS BIGINT) FROM o
UNION ALL SELECT 'constant', 'month_no', CAST(min(month_no) = max(month_no) AS BIGINT) FROM o
UNION ALL SELECT 'missing_periods', 'month_no', CAST(max(month_no) - min(month_no) + 1 - count(DISTINCT month_no) AS BIGINT) FROM o""",
    "prevalence": "SELECT c_mktsegment AS level, count(*) AS n, round(avg(CAST(c_acctbal >= 5000 AS INTEGER)), 6) AS share FROM customer GROUP BY 1 HAVING count(*) >= 10",
    "prevalence_weighted": """WITH b AS (SELECT CASE WHEN l_quantity < 1 THEN NULL WHEN l_quantity < 10 THEN '1-10' WHEN l_quantity < 20 THEN '10-20' WHEN l_quantity < 30 THEN '20-30' WHEN l_quantity < 40 THEN '30-40' ELSE '40+' END AS level,
CAST(l_quantity AS DECIMAL(18,4)) AS w, l_discount AS v FROM lineitem)
SELECT level, count(*) AS n, round(CAST(sum(CASE WHEN v >= 0.05 THEN w ELSE 0 END) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 9) AS share FROM b WHERE level IS NOT NULL AND w > 0 GROUP BY 1 HAVING count(*) >= 10""",
    "weighted_means": " UNION ALL ".join(
        f"SELECT '{v}' AS measure, count(*) AS n, round(CAST(sum(CAST(l_quantity AS DECIMAL(12,4)) * CAST({v} AS DECIMAL(14,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE), 6) AS mean FROM lineitem WHERE l_quantity > 0 AND {v} IS NOT NULL"
        for v in ("l_extendedprice", "l_discount", "l_tax")
    ),
    "rates": """WITH x AS (SELECT l_linestatus AS segment, CAST(l_returnflag = 'R' AS INTEGER) AS c, CAST(l_quantity AS DECIMAL(18,4)) AS p FROM lineitem WHERE l_quantity > 0),
t AS (SELECT segment, CAST(sum(c) AS DOUBLE) AS cases, CAST(sum(p) AS DOUBLE) AS population FROM x GROUP BY 1 UNION ALL SELECT '(all)', CAST(sum(c) AS DOUBLE), CAST(sum(p) AS DOUBLE) FROM x)
SELECT segment, cases, population, round(1000.0 * cases / population, 6) AS rate, CAST(CASE WHEN segment <> '(all)' THEN rank() OVER (PARTITION BY segment = '(all)' ORDER BY 1000.0 * cases / population DESC) END AS INTEGER) AS position FROM t""",
    "price_volume_mix": f"""{_W}, c AS (SELECT brand, coalesce({_sum(BEFORE, "revenue")}, 0) AS r0, coalesce({_sum(BEFORE, "units")}, 0) AS q0, coalesce({_sum(NOW, "revenue")}, 0) AS r1, coalesce({_sum(NOW, "units")}, 0) AS q1 FROM sales GROUP BY 1),
s AS (SELECT *, r0 > 0 AND q0 > 0 AND r1 > 0 AND q1 > 0 AS ok FROM c), t AS (SELECT sum(q0) AS t0, sum(q1) AS t1 FROM s WHERE ok)
SELECT round(coalesce(sum(CASE WHEN ok THEN (t1 * q0 / t0 - q0) * (r0 / q0) END), 0), 3) AS volume, round(coalesce(sum(CASE WHEN ok THEN (q1 - t1 * q0 / t0) * (r0 / q0) END), 0), 3) AS mix,
round(coalesce(sum(CASE WHEN ok THEN q1 * (r1 / q1 - r0 / q0) END), 0), 3) AS price, round(coalesce(sum(CASE WHEN NOT ok THEN r1 - r0 END), 0), 3) AS other, round(sum(r1 - r0), 3) AS change, count(*) FILTER (ok) AS segments FROM s, t""",
    "segment_growth": f"""{_W}, t AS (SELECT nation AS segment, coalesce({_sum(BEFORE, "revenue")}, 0) AS previous, coalesce({_sum(NOW, "revenue")}, 0) AS current FROM sales GROUP BY 1),
e AS (SELECT *, current / previous - 1 AS growth FROM t WHERE previous > 0 AND previous >= 0.02 * (SELECT sum(previous) FROM t))
SELECT segment, round(previous, 6) AS previous, round(current, 6) AS current, round(growth, 6) AS growth, CAST(row_number() OVER (ORDER BY growth DESC, segment) AS INTEGER) AS position FROM e
WHERE (SELECT count(*) FROM e) >= 2 AND (SELECT max(growth) > min(growth) FROM e)""",
    "customer_view": f"""{_S}, per AS (SELECT customer_id AS c, sum(revenue) AS net, count(DISTINCT month_no) AS f FROM sales WHERE customer_id IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY net DESC, c) AS rn, count(*) OVER () AS n FROM per), p AS (SELECT CAST(sum(CASE WHEN net > 0 THEN net END) AS DOUBLE) AS positive FROM per)
SELECT count(*) AS customers, round(CAST(sum(CASE WHEN rn <= 10 THEN greatest(net, 0) END) AS DOUBLE) / max(positive), 9) AS top_ten_share,
round(CAST(sum(CASE WHEN rn <= n // 10 THEN greatest(net, 0) END) AS DOUBLE) / max(positive), 9) AS top_tenth_share, round(avg(CAST(f > 1 AS INTEGER)), 9) AS repeat_share,
(SELECT round(avg(CAST(customer_id IS NULL AS INTEGER)), 9) FROM sales) AS unknown_share FROM r, p HAVING count(*) >= 10""",
    "customer_new_returning": f"""{_W}, per AS (SELECT customer_id, min(month_no) AS first, max(month_no) AS last, {_sum(NOW, "revenue")} AS money FROM sales WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN first >= (SELECT c0 FROM bounds) THEN 'new' ELSE 'returning' END AS kind, count(*) AS customers, round(CAST(sum(CAST(money AS DECIMAL(18,4))) AS DOUBLE), 4) AS money FROM per
WHERE last >= (SELECT c0 FROM bounds) GROUP BY 1""",
    "rfm": f"{_RFM_SQL} SELECT customer, CAST(recency AS INTEGER) AS recency, frequency, round(money, 4) AS money, recency_score, frequency_score, money_score, rfm_segment FROM seg",
    "rfm_segments": f"""{_RFM_SQL} SELECT rfm_segment, count(*) AS customers, round(CAST(sum(CAST(money AS DECIMAL(18,4))) AS DOUBLE), 4) AS money,
round(CAST(sum(CAST(money AS DECIMAL(18,4))) AS DOUBLE) / CAST((SELECT sum(CAST(money AS DECIMAL(18,4))) FROM seg) AS DOUBLE), 4) AS money_share FROM seg GROUP BY 1""",
}
