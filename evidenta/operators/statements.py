"""Fact-checks of statements: changes, shares and ranks against the table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.scalars import everything, label, money, month_key, quarter_key, year_key

TOLERANCE = 0.5  # percentage points
TOP = 5
KEYS = {"month": month_key, "quarter": quarter_key, "year": year_key}
# Month names in labels.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}

#: How people write a period: the period, a pattern with the groups y (year), q (quarter), m (month) or name.
LABELS = tuple(
    (period, re.compile(pattern))
    for period, pattern in (
        ("month", r"(?P<name>[a-z]{3})[a-z]{0,6}\.? +(?P<y>\d{4})"),
        ("month", r"(?P<y>\d{4})[-/](?P<m>0?[1-9]|1[0-2])"),
        ("quarter", r"(?P<y>\d{4}) *-? *q(?P<q>[1-4])"),
        ("quarter", r"q(?P<q>[1-4]) *-? *(?P<y>\d{4})"),
        ("year", r"(?:fy *)?(?P<y>\d{4})"),
    )
)


def parse_period(text: str) -> tuple[str, str] | None:
    """(period, key) of a label such as ``FY2024``, ``2024``, ``2024Q3``, ``Q3 2024``, ``2024-03``, ``2024/3`` or ``Mar 2024``."""
    written = " ".join(text.lower().split())
    for period, pattern in LABELS:
        if found := pattern.fullmatch(written):
            part = found.groupdict()
            if period == "year":
                return period, part["y"]
            if period == "quarter":
                return period, f"{part['y']}Q{part['q']}"
            month = MONTHS.get(part["name"], 0) if part.get("name") else int(part["m"])
            if month:
                return period, f"{part['y']}-{month:02d}"
    return None


def earlier(period: str, key: str) -> tuple[str, str]:
    """Keys of the period before and of the same period a year before."""
    year = int(key[:4])
    if period == "year":
        return f"{year - 1:04d}", f"{year - 1:04d}"
    if period == "quarter":
        q = int(key[5])
        return (f"{year}Q{q - 1}" if q > 1 else f"{year - 1}Q4"), f"{year - 1}Q{q}"
    m = int(key[5:])
    return (f"{year}-{m - 1:02d}" if m > 1 else f"{year - 1}-12"), f"{year - 1}-{m:02d}"


def check_change(df: DataFrame, time: str, measure: str, label_text: str, claimed: float) -> DataFrame:
    """One row: the change against the period before and a year before, and whether the claim matches one.

    ``matches`` the previous period, ``ambiguous`` when only the year before fits, ``off_by`` otherwise.
    """
    parsed = parse_period(label_text)
    if parsed is None:
        return df.sparkSession.createDataFrame([(label_text, None, None, "cannot_check")], "period string, change_previous double, change_year double, result string")
    period, key = parsed
    before, year_before = earlier(period, key)
    at = KEYS[period](F.col(time))
    total = lambda k: F.sum(F.when(at == k, money(F.col(measure)))).cast("double")
    row = df.agg(total(key).alias("now"), total(before).alias("prev"), total(year_before).alias("year"))
    change = lambda base: F.when(F.col(base) > 0, 100.0 * (F.col("now") - F.col(base)) / F.col(base))
    near = lambda c: F.coalesce(F.abs(F.col(c) - claimed) <= TOLERANCE, F.lit(False))
    out = row.select(F.lit(key).alias("period"), change("prev").alias("change_previous"), change("year").alias("change_year"))
    result = F.when(F.col("change_previous").isNull() & F.col("change_year").isNull(), "cannot_check").when(near("change_previous"), "matches").when(near("change_year"), "ambiguous").otherwise("off_by")
    return out.withColumn("result", result)


def check_share(df: DataFrame, segment: str, measure: str, group: str, claimed: float) -> DataFrame:
    """One row: the group's share of the total in percent, whatever its spelling's case."""
    totals = df.agg(F.sum(money(F.col(measure))).cast("double").alias("total"), F.sum(F.when(F.lower(label(F.col(segment))) == group.lower(), money(F.col(measure)))).cast("double").alias("part"))
    share = F.when(F.col("total") > 0, 100.0 * F.col("part") / F.col("total"))
    out = totals.select(F.lit(group).alias("segment"), share.alias("share"))
    return out.withColumn("result", F.when(F.col("share").isNull(), "cannot_check").when(F.abs(F.col("share") - claimed) <= TOLERANCE, "matches").otherwise("off_by"))


def rank_board(df: DataFrame, segment: str, measure: str, top: int = TOP) -> DataFrame:
    totals = df.groupBy(label(F.col(segment)).alias("segment")).agg(F.sum(money(F.col(measure))).cast("double").alias("total"))
    ranked = totals.withColumn("position", F.rank().over(Window.orderBy(F.col("total").desc_nulls_last()))).withColumn("segments", F.count(F.lit(1)).over(everything()))
    return ranked.where(F.col("position") <= top)


def check_rank(df: DataFrame, segment: str, measure: str, group: str, claimed: int) -> DataFrame:
    """One row: the group's place by total."""
    board = rank_board(df, segment, measure, 1 << 30)
    return board.where(F.lower("segment") == group.lower()).select("segment", "position", F.when(F.col("position") == claimed, "matches").otherwise("off_by").alias("result"))


def linked_proofs(statements: DataFrame, proofs: DataFrame) -> DataFrame:
    """Association statements with the proof of their pair of columns, in either order; causal ones are never testable."""
    pair = lambda a, b: F.concat_ws("|", F.array_sort(F.array(F.col(a), F.col(b))))
    keyed = proofs.select(pair("var_a", "var_b").alias("pair"), "claim_id", "verdict")
    out = statements.withColumn("pair", pair("var_x", "var_y")).join(keyed, "pair", "left").drop("pair")
    return out.withColumn("result", F.when(F.col("kind") == "causal", "not_testable").when(F.col("verdict").isNull(), "not_tested").otherwise(F.col("verdict")))


def supported_number(stored: float, shown: str) -> bool:
    """Whether a number in a text rounds half-up from a stored value."""
    from decimal import ROUND_HALF_UP, Decimal

    plain = shown.replace(",", "").rstrip("%")
    return Decimal(repr(stored)).quantize(Decimal(1).scaleb(-len(plain.partition(".")[2])), ROUND_HALF_UP) == Decimal(plain)


