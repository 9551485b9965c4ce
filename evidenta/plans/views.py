"""Analysis tables over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.functions.scalars import money, month_key, month_no
from evidenta.operators.exact import incomplete_last_period


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of the transactions and the tables beside lineitem that each one needs.
SALES_NEEDS = {
    "order_id": (), "line_no": (), "units": (), "revenue": (), "discount": (), "cost": ("part",), "brand": ("part",),
    "order_date": ("orders",), "month": ("orders",), "month_no": ("orders",), "priority": ("orders",), "customer_id": ("orders",),
    "segment": ("orders", "customer"), "nation": ("orders", "customer", "nation"), "region": ("orders", "customer", "nation", "region"),
}


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Transactions: one row per order line, with the columns asked for (all of them without).

    An inner join cannot be pruned by the planner, so only the tables that the columns need are joined.  nation and
    region are fixed lists of 25 and 5 rows, so they are broadcast; the sides that grow are left to the planner, which
    broadcasts them only while their size allows.
    """
    wanted = columns or tuple(SALES_NEEDS)
    needed = {side for c in wanted for side in SALES_NEEDS[c]}
    out = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        out = out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in needed:
        out = out.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "customer" in needed:
        customers = table(spark, sf_dir, "customer")
        if "nation" in needed:
            customers = customers.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        if "region" in needed:
            customers = customers.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        out = out.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    made = {
        "order_id": lambda: F.col("l_orderkey"), "line_no": lambda: F.col("l_linenumber"), "order_date": lambda: F.col("o_orderdate"),
        "month": lambda: month_key(F.col("o_orderdate")), "month_no": lambda: month_no(F.col("o_orderdate")), "region": lambda: F.col("r_name"),
        "nation": lambda: F.col("n_name"), "segment": lambda: F.col("c_mktsegment"), "priority": lambda: F.col("o_orderpriority"),
        "brand": lambda: F.col("p_brand"), "customer_id": lambda: F.col("o_custkey"), "units": lambda: F.col("l_quantity"),
        "revenue": lambda: money(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "cost": lambda: money(F.col("l_quantity") * F.col("p_retailprice")),
        "discount": lambda: F.col("l_discount"),
    }
    return out.select(*[made[c]().alias(c) for c in wanted])


def sales_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``month_no`` of every order: the periods of ``sales``, without its lines."""
    return table(spark, sf_dir, "orders").select(month_no(F.col("o_orderdate")).alias("month_no"))


def region_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel: revenue, cost, units and lines of each region and month."""
    rows = sales(spark, sf_dir, "region", "month", "month_no", "revenue", "cost", "units")
    return rows.groupBy("region", "month", "month_no").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("cost").cast("double").alias("cost"),
        F.sum(money(F.col("units"))).cast("double").alias("units"), F.count(F.lit(1)).alias("lines"),
    )


def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series: orders by month."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return orders.groupBy(month_key(F.col("o_orderdate")).alias("month"), month_no(F.col("o_orderdate")).alias("month_no")).agg(
        F.sum(money(F.col("o_totalprice"))).cast("double").alias("total"), F.count(F.lit(1)).alias("n_rows"),
        F.max(F.dayofmonth("o_orderdate")).alias("last_day"),
    )


def whole_months(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``df`` without the last month of the orders, if that one is incomplete."""
    last = incomplete_last_period(month_series(spark, sf_dir)).where("incomplete").select(F.col("latest").alias("cut_month"))
    return df.join(F.broadcast(last), F.col("month_no") == F.col("cut_month"), "left_anti")


#: The same views for the cross-engine checks.
SALES_SQL = """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_orderdate AS order_date, strftime(o_orderdate, '%Y-%m') AS month,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no, r_name AS region, n_name AS nation,
    c_mktsegment AS segment, o_orderpriority AS priority, p_brand AS brand, c_custkey AS customer_id, l_quantity AS units,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue, CAST(l_quantity * p_retailprice AS DECIMAL(18,4)) AS cost,
    l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

REGION_MONTH_SQL = """region_month AS (
  SELECT region, month, month_no, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(cost) AS DOUBLE) AS cost,
    CAST(sum(CAST(units AS DECIMAL(18,4))) AS DOUBLE) AS units, count(*) AS lines FROM sales GROUP BY 1, 2, 3)"""

MONTH_SERIES_SQL = """month_series AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n_rows, max(day(o_orderdate)) AS last_day
  FROM orders GROUP BY 1, 2)"""

#: The months that count: all but an incomplete last one (few rows, or ended early, against the usual of the months before).
WHOLE_SQL = """last_month AS (SELECT hi AS cut_month, periods >= 4 AND (coalesce(usual_rows >= 4 AND last_rows < 0.5 * usual_rows, false) OR coalesce(usual_day > 1 AND end_day < 0.7 * usual_day, false)) AS incomplete
  FROM (SELECT hi, periods, max(CASE WHEN m = hi THEN n END) AS last_rows, median(CASE WHEN m < hi THEN n END) AS usual_rows, max(CASE WHEN m = hi THEN d END) AS end_day, median(CASE WHEN m < hi THEN d END) AS usual_day
    FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, count(*) AS n, max(day(o_orderdate)) AS d FROM orders GROUP BY 1),
      (SELECT max(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS hi, count(DISTINCT year(o_orderdate) * 12 + month(o_orderdate)) AS periods FROM orders) GROUP BY 1, 2))"""

#: The current and previous window: the last 12 months against the 12 before, if all 24 are there.
WINDOW_SQL = """periods AS (SELECT DISTINCT month_no FROM sales WHERE month_no IS NOT NULL),
latest AS (SELECT max(month_no) AS hi, (SELECT max(month_no) FROM periods WHERE month_no < (SELECT max(month_no) FROM periods)) AS before_hi,
  (SELECT count(*) FROM periods WHERE month_no > (SELECT max(month_no) FROM periods) - 24) AS present FROM periods),
bounds AS (SELECT CASE WHEN present = 24 THEN hi - 11 ELSE hi END AS c0, hi AS c1,
  CASE WHEN present = 24 THEN hi - 23 ELSE before_hi END AS p0, CASE WHEN present = 24 THEN hi - 12 ELSE before_hi END AS p1 FROM latest)"""
