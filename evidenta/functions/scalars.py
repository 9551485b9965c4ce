"""Column expressions that every analysis shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

MISSING = "(missing)"
MISSING_MARKERS = ("?", "NA", "N/A", "NULL", "null", "")
YEARS = (1800, 2200)


def num(c: Column) -> Column:
    """A double; text that does not parse, NaN and infinities are null."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def money(c: Column, scale: int = 4) -> Column:
    """An exact amount: sums of decimals do not depend on the order of rows."""
    return c.cast(f"decimal(18,{scale})")


def exact_sum(c: Column) -> Column:
    return F.sum(c).cast("double")


def label(c: Column) -> Column:
    """A segment label; missing values form a segment of their own."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def stamp(c: Column) -> Column:
    """A timestamp; text that does not parse and years outside YEARS are null."""
    t = c.try_cast("timestamp")
    return F.when(F.year(t).between(*YEARS), t)


def month_key(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def quarter_key(t: Column) -> Column:
    return F.concat(F.year(t).cast("string"), F.lit("Q"), F.quarter(t).cast("string"))


def week_key(t: Column) -> Column:
    """Monday/Sunday of the week."""
    monday = F.date_trunc("week", t).cast("date")
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def day_key(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def year_key(t: Column) -> Column:
    return F.date_format(t, "yyyy")


PERIOD_KEYS = {"day": day_key, "week": week_key, "month": month_key, "quarter": quarter_key, "year": year_key}


def month_no(t: Column) -> Column:
    """Months since year 0: consecutive months are consecutive numbers."""
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def close(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Equal up to a tolerance on the expected side ``b``."""
    return F.abs(a - b) <= F.lit(tolerance) + F.lit(tolerance) * F.abs(b)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null unless whole is above 0."""
    return F.when(whole > 0, 100.0 * part / whole)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null for a constant column, where ``corr`` would divide by zero."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = lambda c: F.when(x.isNotNull() & y.isNotNull(), c)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both(x)) * F.stddev_pop(both(y)))


def mid_rank(value: Column, *partition: Column | str) -> Column:
    """Average rank among ties."""
    by = Window.partitionBy(*partition)
    return F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2.0


def everything() -> WindowSpec:
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def whole(*partition: str) -> WindowSpec:
    return Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def seeded(seed: int | str, *parts: Column) -> Column:
    """A hash that orders rows at random, the same in every engine and on every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def compare(left: Column, op: str, right: Column) -> Column:
    return {">=": left >= right, ">": left > right, "<=": left <= right, "<": left < right, "==": left == right}[op]


def bands(value: Column, edges: list[float]) -> Column:
    """Half-open bands [a, b) of ascending edges, the last one open; null below the first edge."""
    out = None
    for low, high in zip(edges, [*edges[1:], None], strict=True):
        name = F.lit(f"{low:g}+" if high is None else f"{low:g}-{high:g}")
        inside = value >= low if high is None else (value >= low) & (value < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def derived(kind: str, x: Column, y: Column) -> Column:
    """difference, sum, product, ratio or body-mass index of two columns."""
    return {"difference": x - y, "sum": x + y, "product": x * y, "ratio": F.try_divide(x, y), "bmi": F.try_divide(x, F.pow(y / 100.0, F.lit(2)))}[kind]


def without_codes(value: Column, codes: list[float]) -> Column:
    """Non-answer codes become null."""
    return F.when(~value.isin(codes), value)


def escape_cell(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets an apostrophe in front."""
    return F.when(c.rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def shown(c: Column) -> Column:
    """A number with thousands separators and at most two decimals."""
    return F.regexp_replace(F.format_number(c, 2), "\\.00$", "")
