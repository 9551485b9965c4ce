"""Known-answer tables: the expected numbers follow from how the tables are built."""

import math

import pytest
from pyspark.sql import functions as F

from evidenta.functions.scalars import month_no
from evidenta.operators import exact as E
from evidenta.operators import prepare as P
from evidenta.operators import statements as X
from evidenta.operators.windows import window_pair


@pytest.fixture(scope="module")
def finance_year(spark):
    """Twelve months and four regions; total of month m is 280 + 13 m, of which North adds 10 a month."""
    rows = []
    for m in range(12):
        for region, base, step in (("North", 100, 10), ("South", 80, 1), ("East", 60, 1), ("West", 40, 1)):
            revenue = float(base + step * m)
            cost = 0.6 * revenue + (500 if region == "West" and m == 2 else 0)
            rows.append((f"2025-{m + 1:02d}-01", region, revenue, cost, revenue - cost))
    df = spark.createDataFrame(rows, "month string, region string, revenue double, cost double, profit double")
    return df.withColumn("month_no", month_no(F.to_date("month")))


@pytest.fixture(scope="module")
def finance_two_years(spark):
    rows = []
    for m in range(24):
        bump = 50.0 if m % 12 == 11 else 0.0
        rows += [(2024 * 12 + m, "North", 100 + m / 10 + bump), (2024 * 12 + m, "South", 100 - m / 10 + bump)]
    return spark.createDataFrame(rows, "month_no int, region string, revenue double")


def test_period_change_of_the_last_two_months(finance_year):
    pair = window_pair(finance_year)
    row = E.period_change(finance_year, ["revenue"], pair).first()
    assert (row["current"], row["previous"], row["change"]) == (423, 410, 13)
    assert row["percent"] == pytest.approx(100 * 13 / 410)


def test_variance_shares_sum_to_one(finance_year):
    rows = {r["segment"]: r for r in E.variance_decomposition(finance_year, "region", "revenue", window_pair(finance_year)).collect()}
    assert rows["North"]["change"] == 10 and rows["North"]["share"] == pytest.approx(10 / 13)
    assert sum(r["share"] for r in rows.values()) == pytest.approx(1)


def test_identity_and_cost_outlier(finance_year):
    row = E.identity(finance_year, "profit", F.col("revenue") - F.col("cost")).first()
    assert (row["n"], row["share"], row["reported"]) == (48, 1.0, True)
    assert "2025-03-01" in {r["month"] for r in E.period_outliers(finance_year, "month", "cost").collect()}


def test_two_years_seasonality(finance_two_years):
    pair = window_pair(finance_two_years)
    assert pair.previous == (2024 * 12, 2024 * 12 + 11) and pair.current == (2025 * 12, 2025 * 12 + 11)
    row = E.period_change(finance_two_years, ["revenue"], pair).first()
    assert row["change"] == pytest.approx(0)
    rows = {r["position"]: r["index"] for r in E.seasonality(finance_two_years, "revenue").collect()}
    assert max(rows, key=rows.get) == 12 and rows[12] == pytest.approx(300 / (2500 / 12))


def test_weighted_prevalence(spark):
    rows = [(31.0, 3.0)] * 10 + [(25.0, 1.0)] * 30
    df = spark.createDataFrame(rows, "bmi double, weight double")
    assert E.prevalence(df, "bmi", ">=", 30).first()["share"] == 0.25
    assert E.prevalence(df, "bmi", ">=", 30, "weight").first()["share"] == 0.5
    assert E.prevalence(df.limit(20), "bmi", ">=", 30).count() == 0


def test_price_volume_mix_parts_sum(spark):
    rows = [(0, "Core", 100.0, 1000.0), (0, "Lite", 50.0, 250.0), (1, "Core", 75.0, 900.0), (1, "Lite", 60.0, 300.0), (1, "New", 5.0, 40.0)]
    df = spark.createDataFrame(rows, "month_no int, product string, units double, revenue double")
    r = E.price_volume_mix(df, "product", "revenue", "units", window_pair(df)).first()
    assert r["volume"] + r["mix"] + r["price"] + r["other"] == pytest.approx(r["change"])
    assert r["price"] == pytest.approx(75 * 2) and r["other"] == 40 and r["segments"] == 2


def test_shapes_and_roles(spark, finance_year):
    dated = finance_year.withColumn("date", F.to_date("month"))
    assert P.table_shape(dated, "date", "region").first()["shape"] == "panel"
    assert P.table_shape(dated.where("region = 'North'"), "date").first()["shape"] == "time_series"
    assert P.table_shape(dated, None).first()["shape"] == "cross_section"
    roles = {r["column_name"]: r["role"] for r in P.column_roles(finance_year).collect()}
    assert (roles["month"], roles["region"], roles["revenue"], roles["month_no"]) == ("datetime", "categorical", "numeric", "ordinal")


def test_names():
    assert P.name_words("PatientID") == ["patient", "id"] and P.name_words("v024") == ["v", "024"]
    assert P.names_time_axis("survey_year") and not P.names_time_axis("WTMEC2YR") and not P.names_time_axis("return_5_year")


def test_cleaning(spark):
    rows = [("1", "a", "k", None), ("1", "a", "k", None), ("?", "b", "k", None), ("3.5", "c", "k", None)]
    out = P.clean(spark.createDataFrame(rows, "x string, y string, same string, gone string"))
    assert out.columns == ["x", "y"] and dict(out.dtypes)["x"] == "double"
    assert sorted((r["x"] is None, r["x"], r["y"]) for r in out.collect())[:2] == [(False, 1.0, "a"), (False, 3.5, "c")]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("FY2024", ("year", "2024")), ("2024Q3", ("quarter", "2024Q3")), ("Q3 2024", ("quarter", "2024Q3")), ("2024-03", ("month", "2024-03")), ("Mar 2024", ("month", "2024-03")), ("soon", None), ("2024-13", None)],
)
def test_period_labels(text, expected):
    assert X.parse_period(text) == expected


def test_statement_outcomes(finance_year):
    df = finance_year.withColumn("date", F.to_date("month"))
    assert X.check_change(df, "date", "revenue", "Dec 2025", 3.2).first()["result"] == "matches"
    assert X.check_change(df, "date", "revenue", "Dec 2025", 9.0).first()["result"] == "off_by"
    assert X.check_change(df, "date", "revenue", "someday", 9.0).first()["result"] == "cannot_check"
    assert X.supported_number(3.1707, "3.2%") and not X.supported_number(3.1707, "3.1")


def test_empty_tables_give_no_figures(spark, finance_year):
    none = finance_year.limit(0)
    assert window_pair(none) is None
    assert E.concentration(none, "region", "revenue").count() == 0
    assert E.seasonality(none, "revenue").count() == 0
    assert E.row_outliers(none, ["month"], "region", "revenue").count() == 0
    assert math.isclose(E.pareto(finance_year, "region", "revenue").agg(F.max("cumulative_share")).first()[0], 1.0)
