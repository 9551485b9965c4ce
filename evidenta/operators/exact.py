"""Exact figures: closed-form aggregates of one table.

Every function takes a table and column names and returns one long-form table of figures.  Two windows are compared
by conditional sums in a single aggregation, never by joining two aggregates.  Amounts are summed as decimals, so a
figure does not depend on the order or partitioning of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.quantiles import exact_quantile, running_total
from evidenta.functions.scalars import bands, close, compare, everything, label, money, percent, share, whole, without_codes
from evidenta.operators.windows import WindowPair
from evidenta.plans.config import EXACT


def _when_sum(flag: Column, value: Column) -> Column:
    return F.sum(F.when(flag, money(value))).cast("double")


def _both(df: DataFrame, by: list[Column], value: str, pair: WindowPair, ordinal: str) -> DataFrame:
    """previous and current total per group; a group without rows in a window has 0 there."""
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.coalesce(_when_sum(pair.before(F.col(ordinal)), F.col(value)), zero).alias("previous"),
        F.coalesce(_when_sum(pair.now(F.col(ordinal)), F.col(value)), zero).alias("current"),
    )


def period_change(df: DataFrame, measures: list[str], pair: WindowPair, ordinal: str = "month_no") -> DataFrame:
    """measure, current, previous, change, percent (null unless previous is above 0); totals of no value are null."""
    wide = df.agg(
        *[_when_sum(pair.now(F.col(ordinal)), F.col(m)).alias(f"c_{m}") for m in measures],
        *[_when_sum(pair.before(F.col(ordinal)), F.col(m)).alias(f"p_{m}") for m in measures],
    )
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"c_{m}").alias("current"), F.col(f"p_{m}").alias("previous")) for m in measures])
    flat = wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("change", F.col("current") - F.col("previous"))
    return flat.withColumn("percent", percent(F.col("change"), F.col("previous")))


def margins(df: DataFrame, revenue: str, cost: str, groups: list[str], pair: WindowPair, ordinal: str = "month_no", rows: int = 5) -> DataFrame:
    """Margin of both windows over rows that have both amounts: in total and for the levels of up to four columns.

    All groupings come from one scan (grouping sets); the ``rows`` levels that fell most of each column are kept.
    """
    both = df.where(F.col(revenue).isNotNull() & F.col(cost).isNotNull()).select(
        F.col(ordinal), F.col(revenue).alias("r"), F.col(cost).alias("c"), *[label(F.col(g)).alias(g) for g in groups]
    )
    now, before = pair.now(F.col(ordinal)), pair.before(F.col(ordinal))
    cells = F.array(
        F.struct(F.lit("(all)").alias("column_name"), F.lit("(all)").alias("level")),
        *[F.struct(F.lit(g).alias("column_name"), F.col(g).alias("level")) for g in groups],
    )
    sums = both.select("*", F.explode(cells).alias("cell")).groupBy("cell").agg(
        _when_sum(now, F.col("r")).alias("r1"), _when_sum(now, F.col("c")).alias("c1"),
        _when_sum(before, F.col("r")).alias("r0"), _when_sum(before, F.col("c")).alias("c0"),
    )
    out = sums.select(
        "cell.*", percent(F.col("r1") - F.col("c1"), F.col("r1")).alias("current"), percent(F.col("r0") - F.col("c0"), F.col("r0")).alias("previous")
    ).withColumn("change", F.col("current") - F.col("previous"))
    order = Window.partitionBy("column_name").orderBy(F.col("change").asc_nulls_last(), "level")
    return out.withColumn("position", F.row_number().over(order)).where(F.col("position") <= rows)


def head_and_other(df: DataFrame, name: str, values: list[str], order: list[Column], most: int = EXACT.segments) -> DataFrame:
    """The first most - 1 rows and an ``other`` row of the rest, if there are more than ``most``."""
    placed = df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).withColumn("groups", F.count(F.lit(1)).over(everything()))
    folded = F.when((F.col("groups") > most) & (F.col("rn") >= most), F.lit("other")).otherwise(F.col(name))
    place = F.when((F.col("groups") > most) & (F.col("rn") >= most), F.lit(most)).otherwise(F.col("rn"))
    return placed.groupBy(folded.alias(name), place.cast("int").alias("position")).agg(*[F.sum(v).alias(v) for v in values])


def variance_decomposition(df: DataFrame, segment: str, measure: str, pair: WindowPair, ordinal: str = "month_no") -> DataFrame:
    """segment, previous, current, change and its share of the total change, in the direction of the total.

    Windows run over one row per segment.  Without a total change there are no rows.
    """
    totals = _both(df, [label(F.col(segment)).alias("segment")], measure, pair, ordinal)
    moved = totals.withColumn("change", money(F.col("current")) - money(F.col("previous")))
    signed = moved.withColumn("total", F.sum("change").over(everything())).where("total <> 0")
    toward = (F.col("change") * F.signum("total")).desc()
    parts = head_and_other(signed.withColumn("change", F.col("change").cast("double")), "segment", ["previous", "current", "change"], [toward, F.col("segment")])
    return parts.withColumn("share", share(F.col("change"), F.sum("change").over(everything())))


def concentration(df: DataFrame, segment: str, measure: str) -> DataFrame:
    """segments, total, largest share and share of the top tenth (from 10 segments on); no rows for negative totals."""
    totals = df.groupBy(label(F.col(segment)).alias("segment")).agg(F.coalesce(F.sum(money(F.col(measure))), F.lit(0)).alias("total"))
    top = F.broadcast(exact_quantile_rank(totals, "total", 10, up=True).withColumn("one", F.lit(0)))
    out = totals.agg(
        F.count(F.lit(1)).alias("segments"), F.sum("total").cast("double").alias("total"), F.min("total").alias("least"),
        F.max("total").cast("double").alias("largest"),
    ).where("least >= 0 and total > 0").withColumn("one", F.lit(0)).join(top, "one").withColumn("top", F.col("top").cast("double"))
    return out.select(
        "segments", "total", (F.col("largest") / F.col("total")).alias("largest_share"),
        F.when(F.col("segments") >= 10, F.col("top") / F.col("total")).alias("top_tenth_share"),
    )


def pareto(df: DataFrame, segment: str, measure: str) -> DataFrame:
    """Segments from the largest with their cumulative share; the tail is one ``other`` row."""
    totals = df.groupBy(label(F.col(segment)).alias("segment")).agg(F.coalesce(F.sum(money(F.col(measure))), F.lit(0)).cast("double").alias("total"))
    parts = head_and_other(totals, "segment", ["total"], [F.col("total").desc(), F.col("segment")])
    running = F.sum(money(F.col("total"))).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return parts.withColumn("cumulative_share", running / F.sum(money(F.col("total"))).over(everything()).cast("double"))


def segment_ranking(df: DataFrame, segment: str, measure: str, additive: bool = True) -> DataFrame:
    """total, mean, rows and share of the grand total per segment, ranked by total (additive) or mean."""
    totals = df.groupBy(label(F.col(segment)).alias("segment")).agg(
        F.sum(money(F.col(measure))).cast("double").alias("total"), F.count(measure).alias("n")
    )
    rated = totals.withColumn("mean", F.col("total") / F.col("n"))
    order = Window.orderBy(F.col("total" if additive else "mean").desc_nulls_last(), "segment")
    return rated.withColumn("share", share(F.col("total"), F.sum(money(F.col("total"))).over(everything()).cast("double"))).withColumn(
        "position", F.row_number().over(order)
    )


def robust_z(df: DataFrame, value: str, median: Column, mad: Column, mean_dev: Column) -> Column:
    """(x - median) / (1.4826 MAD), or / (1.2533 mean deviation) where the MAD is 0; null where both are 0."""
    scale = F.when(mad > 0, 1.4826 * mad).when(mean_dev > 0, 1.2533 * mean_dev)
    return (F.col(value) - median) / scale


def flagged_outliers(points: DataFrame, key: str, value: str, cutoff: float = EXACT.robust_z, least: int = 5) -> DataFrame:
    """Points with a robust z of ``cutoff`` or more, out of at least ``least`` points.

    ``points`` is a series with one row per period, so its windows are as long as the calendar.
    """
    known = points.where(F.col(value).isNotNull())
    centred = known.withColumn("median", F.percentile(value, 0.5).over(everything())).withColumn("n", F.count(F.lit(1)).over(everything()))
    away = centred.withColumn("away", F.abs(F.col(value) - F.col("median")))
    scaled = away.withColumn("mad", F.percentile("away", 0.5).over(everything())).withColumn("mean_dev", F.avg("away").over(everything()))
    z = robust_z(scaled, value, F.col("median"), F.col("mad"), F.col("mean_dev"))
    return scaled.withColumn("z", z).where((F.abs(F.col("z")) >= cutoff) & (F.col("n") >= least)).select(key, value, "median", "z")


def period_outliers(df: DataFrame, period: str, measure: str) -> DataFrame:
    totals = df.groupBy(period).agg(F.sum(money(F.col(measure))).cast("double").alias("total"))
    return flagged_outliers(totals, period, "total")


def row_outliers(df: DataFrame, keys: list[str], segment: str, measure: str, cutoff: float = EXACT.robust_z) -> DataFrame:
    """Rows whose log ratio to the median of their segment's positive values is an outlier.

    The medians come from bracketed selection, so neither a segment nor the table is gathered in one task.  The narrow
    rows are read several times and are persisted (memory, then disk).
    """
    rows = df.select(*keys, label(F.col(segment)).alias("segment"), F.col(measure).cast("double").alias("value")).where("value > 0").persist()
    medians = exact_quantile(rows, "value", 0.5, ["segment"], "segment_median").select(F.col("segment").alias("s"), "segment_median")
    logs = rows.join(medians, F.col("segment") == F.col("s")).withColumn("ratio", F.log(F.col("value") / F.col("segment_median"))).persist()
    centre = exact_quantile(logs, "ratio", 0.5, None, "q").first()
    if centre is None:
        return logs.select(*keys, "segment", "value", "segment_median", F.lit(None).cast("double").alias("z")).limit(0)
    away = logs.withColumn("away", F.abs(F.col("ratio") - F.lit(centre["q"])))
    mad = exact_quantile(away, "away", 0.5, None, "q").first()["q"]
    scale = 1.4826 * mad if mad > 0 else 1.2533 * (away.agg(F.avg("away")).first()[0] or 0.0)
    if scale <= 0:
        return away.select(*keys, "segment", "value", "segment_median", F.lit(None).cast("double").alias("z")).limit(0)
    z = (F.col("ratio") - F.lit(centre["q"])) / F.lit(scale)
    return away.withColumn("z", z).where(F.abs(F.col("z")) >= cutoff).select(*keys, "segment", "value", "segment_median", "z")


def seasonality(df: DataFrame, measure: str, ordinal: str = "month_no", year: int = 12) -> DataFrame:
    """position, mean total and index over the years that hold every position; no rows if the mean is not above 0."""
    place = df.select(F.floor(F.col(ordinal) / year).cast("int").alias("year"), (F.col(ordinal) % year + 1).cast("int").alias("position"), F.col(measure).alias("v"))
    totals = place.groupBy("year", "position").agg(F.sum(money(F.col("v"))).alias("total"))
    full = totals.withColumn("positions", F.count(F.lit(1)).over(whole("year"))).where(F.col("positions") == year)
    means = full.groupBy("position").agg((F.sum("total").cast("double") / F.count(F.lit(1))).alias("mean_total"), F.count(F.lit(1)).alias("years"))
    overall = F.sum(money(F.col("mean_total"))).over(everything()).cast("double") / year
    return means.withColumn("index", F.when(overall > 0, F.col("mean_total") / overall)).where("index is not null")


def consecutive_tail(df: DataFrame, ordinal: str = "month_no") -> DataFrame:
    """first, last and length of the longest run of consecutive periods that ends at the last one (gaps and islands)."""
    periods = df.where(F.col(ordinal).isNotNull()).select(F.col(ordinal).alias("o")).distinct()
    runs = periods.withColumn("island", F.col("o") - F.row_number().over(Window.orderBy("o")))
    tail = runs.groupBy("island").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count(F.lit(1)).alias("periods"))
    return tail.withColumn("latest", F.max("last").over(everything())).where("last = latest").select("first", "last", "periods")


def rolling_seasonality(df: DataFrame, measure: str, ordinal: str = "month_no", year: int = 12) -> DataFrame:
    """Seasonal index as the ratio to a centred moving average, over the consecutive tail of at least two years.

    The centred average is the mean of two trailing averages, half a year later.  No rows if a total is not above 0.
    """
    totals = df.groupBy(F.col(ordinal).alias("o")).agg(F.sum(money(F.col(measure))).alias("total"))
    tail = consecutive_tail(df, ordinal).where(F.col("periods") >= 2 * year).select("first")
    run = totals.join(F.broadcast(tail), F.col("o") >= F.col("first")).withColumn("least", F.min("total").over(everything())).where("least > 0")
    by = Window.orderBy("o")
    half = year // 2
    trailing = F.when(F.row_number().over(by) >= year, F.sum("total").over(by.rowsBetween(-(year - 1), 0)).cast("double") / year)
    smooth = run.withColumn("trailing", trailing)
    centred = (F.lead("trailing", half - 1).over(by) + F.lead("trailing", half).over(by)) / 2
    ratios = smooth.withColumn("ratio", F.col("total").cast("double") / centred).where("ratio is not null")
    means = ratios.groupBy((F.col("o") % year + 1).cast("int").alias("position")).agg(F.round(F.avg("ratio"), 10).alias("raw"))
    return means.withColumn("index", F.col("raw") / F.avg("raw").over(everything())).select("position", "index")


def incomplete_last_period(series: DataFrame, ordinal: str = "month_no", rows: str = "n_rows", last_day: str | None = "last_day") -> DataFrame:
    """One row: the last period, what is usual before it, and whether it is incomplete.  Needs four periods."""
    placed = series.withColumn("latest", F.max(ordinal).over(everything())).withColumn("periods", F.count(F.lit(1)).over(everything()))
    earlier, last = F.col(ordinal) < F.col("latest"), F.col(ordinal) == F.col("latest")
    figures = placed.groupBy("latest", "periods").agg(
        F.max(F.when(last, F.col(rows))).alias("last_rows"), F.percentile(F.when(earlier, F.col(rows)), 0.5).alias("usual_rows"),
        F.max(F.when(last, F.col(last_day))).alias("last_max_day") if last_day else F.lit(None).cast("int").alias("last_max_day"),
        F.percentile(F.when(earlier, F.col(last_day)), 0.5).alias("usual_max_day") if last_day else F.lit(None).cast("double").alias("usual_max_day"),
    )
    few = (F.col("usual_rows") >= 4) & (F.col("last_rows") < 0.5 * F.col("usual_rows"))
    short = (F.col("usual_max_day") > 1) & (F.col("last_max_day") < 0.7 * F.col("usual_max_day"))
    flag = (F.col("periods") >= 4) & (F.coalesce(few, F.lit(False)) | F.coalesce(short, F.lit(False)))
    return figures.withColumn("incomplete", flag)


def caveats(figures: DataFrame, ordinal: str, incomplete: DataFrame) -> DataFrame:
    """Figures with a flag on those that touch an incomplete last period."""
    last = incomplete.where("incomplete").select(F.col("latest").alias("caveat_period"))
    return figures.join(F.broadcast(last), F.col(ordinal) == F.col("caveat_period"), "left").withColumn("caveat", F.col("caveat_period").isNotNull()).drop("caveat_period")


def missing_periods(df: DataFrame, ordinal: str = "month_no") -> DataFrame:
    """The periods between the first and the last that have no row."""
    present = df.where(F.col(ordinal).isNotNull()).select(F.col(ordinal).alias("o")).distinct()
    calendar = present.agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("period_no"))
    return calendar.join(present, F.col("period_no") == F.col("o"), "left_anti")


def identity(df: DataFrame, result: str, expression: Column, tolerance: float = EXACT.identity_tolerance) -> DataFrame:
    """rows, share of rows where the result equals the expression, and whether that is reported."""
    pairs = df.select(F.col(result).cast("double").alias("r"), expression.cast("double").alias("e")).where("r is not null and e is not null")
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(close(F.col("e"), F.col("r"), tolerance).cast("int")).alias("share"))
    return out.withColumn("reported", (F.col("n") >= EXACT.identity_rows) & (F.col("share") >= EXACT.identity_share))


def data_quality(df: DataFrame, non_negative: list[str], ordinal: str = "month_no") -> DataFrame:
    """(issue, column_name, count): duplicate rows, negatives, constant columns and missing periods."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("v"))
    duplicates = rows.select(F.lit("duplicate_rows").alias("issue"), F.lit("(all)").alias("column_name"), F.col("v").cast("long").alias("count"))
    wide = df.agg(
        *[F.coalesce(F.sum((F.col(c) < 0).cast("long")), F.lit(0)).alias(f"neg_{c}") for c in non_negative],
        *[F.coalesce((F.min(c) == F.max(c)).cast("long"), F.lit(0)).alias(f"con_{c}") for c in df.columns],
    )
    cells = [F.struct(F.lit("negative").alias("issue"), F.lit(c).alias("column_name"), F.col(f"neg_{c}").cast("long").alias("count")) for c in non_negative]
    cells += [F.struct(F.lit("constant").alias("issue"), F.lit(c).alias("column_name"), F.col(f"con_{c}").cast("long").alias("count")) for c in df.columns]
    flat = wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    gaps = missing_periods(df, ordinal).agg(F.count(F.lit(1)).alias("count")).select(F.lit("missing_periods").alias("issue"), F.lit(ordinal).alias("column_name"), "count")
    return duplicates.unionByName(flat).unionByName(gaps)


def prevalence(
    df: DataFrame, value: str, op: str, cut: float, weight: str | None = None, codes: tuple[float, ...] = (), by: Column | None = None, least: int | None = None
) -> DataFrame:
    """(level, n, share) of rows that meet a cut-off; weighted rows need a weight above 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    answer = without_codes(F.col(value).cast("double"), list(codes)) if codes else F.col(value).cast("double")
    level = by.cast("string") if by is not None else F.lit("(all)")
    rows = df.select(answer.alias("v"), w.alias("w"), level.alias("level")).where("v is not null and w > 0 and level is not null")
    met = compare(F.col("v"), op, F.lit(float(cut)))
    out = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(met, money(F.col("w"))).otherwise(0)).cast("double") / F.sum(money(F.col("w"))).cast("double")).alias("share"))
    return out.where(F.col("n") >= (least if least is not None else EXACT.group_rows if by is not None else EXACT.prevalence_rows))


def banded_prevalence(df: DataFrame, value: str, op: str, cut: float, band_on: str, edges: list[float], weight: str | None = None) -> DataFrame:
    return prevalence(df, value, op, cut, weight, by=bands(F.col(band_on).cast("double"), edges))


def weighted_means(df: DataFrame, values: list[str], weight: str | None = None) -> DataFrame:
    """(measure, n, mean); a row needs a value and, if weighted, a weight above 0."""
    w = money(F.col(weight)) if weight else F.lit(1).cast("decimal(18,4)")
    wide = df.agg(
        *[F.sum(F.when((w > 0) & F.col(v).isNotNull(), w.cast("decimal(12,4)") * F.col(v).cast("decimal(14,4)"))).cast("double").alias(f"s_{v}") for v in values],
        *[F.sum(F.when((w > 0) & F.col(v).isNotNull(), w)).cast("double").alias(f"w_{v}") for v in values],
        *[F.count(F.when((w > 0) & F.col(v).isNotNull(), 1)).alias(f"n_{v}") for v in values],
    )
    cells = [F.struct(F.lit(v).alias("measure"), F.col(f"n_{v}").alias("n"), (F.col(f"s_{v}") / F.col(f"w_{v}")).alias("mean")) for v in values]
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def rates(df: DataFrame, cases: str, population: str, segment: str, per: float = 1000.0) -> DataFrame:
    """Cases per thousand in total and by segment, ranked; rows need a population above 0."""
    rows = df.where((F.col(population) > 0) & F.col(cases).isNotNull())
    cells = F.array(F.lit("(all)"), label(F.col(segment)))
    sums = rows.select(F.explode(cells).alias("segment"), money(F.col(cases)).alias("c"), money(F.col(population)).alias("p")).groupBy("segment").agg(
        F.sum("c").cast("double").alias("cases"), F.sum("p").cast("double").alias("population")
    )
    rated = sums.withColumn("rate", per * F.col("cases") / F.col("population"))
    ranked = F.when(F.col("segment") != "(all)", F.rank().over(Window.partitionBy(F.col("segment") == "(all)").orderBy(F.col("rate").desc())))
    return rated.withColumn("position", ranked)


def price_volume_mix(df: DataFrame, segment: str, revenue: str, units: str, pair: WindowPair, ordinal: str = "month_no") -> DataFrame:
    """One row: the change of revenue as volume, mix, price and other; the four parts sum to the change.

    Segments with revenue and units above 0 in both windows are split; the rest is ``other``.
    """
    now, before = pair.now(F.col(ordinal)), pair.before(F.col(ordinal))
    zero = F.lit(0.0)
    cells = df.groupBy(label(F.col(segment)).alias("segment")).agg(
        F.coalesce(_when_sum(before, F.col(revenue)), zero).alias("r0"), F.coalesce(_when_sum(before, F.col(units)), zero).alias("q0"),
        F.coalesce(_when_sum(now, F.col(revenue)), zero).alias("r1"), F.coalesce(_when_sum(now, F.col(units)), zero).alias("q1"),
    ).withColumn("split", (F.col("r0") > 0) & (F.col("q0") > 0) & (F.col("r1") > 0) & (F.col("q1") > 0))
    sized = cells.withColumn("t0", F.sum(F.when(F.col("split"), F.col("q0"))).over(everything())).withColumn("t1", F.sum(F.when(F.col("split"), F.col("q1"))).over(everything()))
    p0, scaled = F.col("r0") / F.col("q0"), F.col("t1") * F.col("q0") / F.col("t0")
    part = lambda x: F.coalesce(F.sum(F.when(F.col("split"), x)), zero)
    return sized.agg(
        part((scaled - F.col("q0")) * p0).alias("volume"), part((F.col("q1") - scaled) * p0).alias("mix"),
        part(F.col("q1") * (F.col("r1") / F.when(F.col("split"), F.col("q1")) - p0)).alias("price"),
        F.coalesce(F.sum(F.when(~F.col("split"), F.col("r1") - F.col("r0"))), zero).alias("other"),
        F.sum(F.col("r1") - F.col("r0")).alias("change"), F.count(F.when(F.col("split"), 1)).alias("segments"),
    )


def segment_growth(df: DataFrame, segment: str, measure: str, pair: WindowPair, ordinal: str = "month_no") -> DataFrame:
    """Growth of segments that held at least 2 % of the earlier total, ranked; no rows for one segment or equal growth."""
    totals = _both(df, [label(F.col(segment)).alias("segment")], measure, pair, ordinal)
    least = F.lit(EXACT.growth_min_share) * F.sum(money(F.col("previous"))).over(everything()).cast("double")
    able = totals.withColumn("least", least).where((F.col("previous") > 0) & (F.col("previous") >= F.col("least")))
    grown = able.withColumn("growth", F.col("current") / F.col("previous") - 1)
    spread = grown.withColumn("n", F.count(F.lit(1)).over(everything())).withColumn("range", F.max("growth").over(everything()) - F.min("growth").over(everything()))
    return spread.where("n >= 2 and range > 0").select(
        "segment", "previous", "current", "growth", F.row_number().over(Window.orderBy(F.col("growth").desc(), "segment")).alias("position")
    )


def customer_totals(df: DataFrame, customer: str, measure: str, ordinal: str = "month_no") -> DataFrame:
    """One row per known customer: net total, first and last period and active periods."""
    return df.where(F.col(customer).isNotNull()).groupBy(F.col(customer).alias("customer")).agg(
        F.coalesce(F.sum(money(F.col(measure))), F.lit(0)).alias("net"), F.min(ordinal).alias("first_period"),
        F.max(ordinal).alias("last_period"), F.count_distinct(ordinal).alias("frequency"),
    )


def customer_view(df: DataFrame, customer: str, measure: str, ordinal: str = "month_no") -> DataFrame:
    """One row: customers, shares of the positive total held by the top ten and the top tenth, repeat share, unknown rows.

    The top tenth comes from running totals by range; only the ten largest customers are ordered.
    """
    totals = customer_totals(df, customer, measure, ordinal)
    figures = totals.agg(
        F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0)).alias("positive"),
        F.avg((F.col("frequency") > 1).cast("int")).alias("repeat_share"),
    )
    ten = totals.orderBy(F.col("net").desc(), "customer").limit(EXACT.top_customers)
    ten = ten.agg(F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("ten"))
    cut = exact_quantile_rank(totals, "net", 10)
    unknown = df.agg(F.avg(F.col(customer).isNull().cast("int")).alias("unknown_share"))
    row = figures.withColumn("k", F.lit(0)).join(F.broadcast(ten.withColumn("k", F.lit(0))), "k")
    row = row.join(F.broadcast(cut.withColumn("k", F.lit(0))), "k").join(F.broadcast(unknown.withColumn("k", F.lit(0))), "k")
    able = row.where((F.col("customers") >= EXACT.customers) & (F.col("positive") > 0))
    positive = F.col("positive").cast("double")
    return able.select(
        "customers", (F.col("ten").cast("double") / positive).alias("top_ten_share"), (F.col("top").cast("double") / positive).alias("top_tenth_share"),
        "repeat_share", "unknown_share",
    )


def exact_quantile_rank(df: DataFrame, value: str, parts: int, up: bool = False) -> DataFrame:
    """One row ``top``: the sum, floored at 0 each, of the floor (or ceiling) of n / parts largest values.

    Values are grouped first, so ties need no order, and added up by range buckets.
    """
    levels = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    running = running_total(levels.withColumn("low", -F.col("v").cast("double")), "low", "m")
    share = F.sum("m") / parts
    want = levels.agg((F.ceil(share) if up else F.floor(share)).cast("long")).scalar()
    taken = F.greatest(F.lit(0), F.least(F.col("m"), want - (F.col("upto") - F.col("m"))))
    return running.agg(F.coalesce(F.sum(F.greatest("v", F.lit(0)) * taken.cast("decimal(18,0)")), F.lit(0)).alias("top"))


def new_and_returning(df: DataFrame, customer: str, measure: str, pair: WindowPair, ordinal: str = "month_no") -> DataFrame:
    """Money of the current window by customers first seen in it (new) and before it (returning)."""
    known = df.where(F.col(customer).isNotNull())
    per = known.groupBy(customer).agg(F.min(ordinal).alias("first"), _when_sum(pair.now(F.col(ordinal)), F.col(measure)).alias("money"), F.max(ordinal).alias("last"))
    kind = F.when(F.col("first") >= pair.current[0], "new").otherwise("returning")
    return per.where(F.col("last") >= pair.current[0]).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum(money(F.col("money"))).cast("double").alias("money")
    )


def rfm(df: DataFrame, customer: str, measure: str, ordinal: str = "month_no") -> DataFrame:
    """Scores 1 to 5 for recency, frequency and money of customers with a net total above 0, and their segment.

    Recency counts periods since the last active one, in positions of periods present.
    """
    periods = df.where(F.col(ordinal).isNotNull()).select(F.col(ordinal).alias("o")).distinct()
    placed = periods.withColumn("pos", F.row_number().over(Window.orderBy("o")) - 1).withColumn("last_pos", F.max("pos").over(everything()))
    totals = customer_totals(df, customer, measure, ordinal).where("net > 0")
    base = totals.join(placed, F.col("last_period") == F.col("o")).select(
        "customer", (F.col("last_pos") - F.col("pos")).alias("recency"), "frequency", F.col("net").cast("double").alias("money")
    )
    base = base.persist()  # one row per customer, read once per score
    ranked = base
    for name, sign in (("recency", -1.0), ("frequency", 1.0), ("money", 1.0)):
        scores = score_levels(base.select((sign * F.col(name)).alias("sk")), f"{name}_score")
        ranked = ranked.join(scores, sign * F.col(name) == F.col("sk")).drop("sk")
    recent, often = F.col("recency_score"), F.col("frequency_score")
    regular = F.when(recent >= 4, "Champions").when(recent >= 2, "Loyal").otherwise("Lapsed regulars")
    rare = F.when(recent >= 4, "Recent").when(recent <= 2, "Lost").otherwise("Middle")
    segment = F.when(often >= 4, regular).when(often <= 2, rare).otherwise("Middle")
    return ranked.withColumn("rfm_segment", segment)


def score_levels(values: DataFrame, name: str) -> DataFrame:
    """(sk, score): ceil(5 * average rank / n) of every distinct value, by running totals over ranges."""
    levels = values.groupBy(F.col("sk").cast("double").alias("sk")).agg(F.count(F.lit(1)).alias("m"))
    n = levels.agg(F.sum("m")).scalar()
    score = F.ceil(5.0 * (F.col("upto") - (F.col("m") - 1) / 2.0) / n).cast("int")
    return running_total(levels, "sk", "m").select("sk", score.alias(name))


def rfm_segments(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"), F.sum(money(F.col("money"))).cast("double").alias("money")).withColumn(
        "money_share", F.col("money") / F.sum(money(F.col("money"))).over(everything()).cast("double")
    )


def derived_discounted(price: Column, discount: Column) -> Column:
    """price * (1 - discount)."""
    return price * (1 - discount)
