"""Effect sizes and association measures, each as one aggregation over (mid-)ranks or moments."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.distributions import chi2_sf, f_sf, t_two_sided
from evidenta.functions.quantiles import exact_quantile, running_total
from evidenta.functions.scalars import everything, safe_corr, whole
from evidenta.plans.config import SCAN

#: Rows up to which all row pairs are compared (Kendall, Sen); longer series are compared by period means.
PAIR_ROWS = 3000


def pairs(df: DataFrame, x: str, y: str, keep: list[str] | None = None) -> DataFrame:
    """Rows with both values, as doubles x and y."""
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *(keep or [])).where("x is not null and y is not null")


def ranked(df: DataFrame, value: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Mid-ranks from one row per distinct value: a running count by range, joined back.

    ``source`` holds the values where ``df`` already carries other ranks, so that several ranks read the rows once each.

    Distinct values are numbered by range buckets, so the sort is distributed; no window holds the table.
    """
    levels = (df if source is None else source).groupBy(F.col(value).alias("lv")).agg(F.count(F.lit(1)).alias("m"))
    upto = running_total(levels, "lv", "m")
    return df.join(upto.select(F.col("lv").alias("lv2"), (F.col("upto") - (F.col("m") - 1) / 2.0).alias(name)), F.col(value) == F.col("lv2")).drop("lv2")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n and r; 0 for a constant column."""
    return pairs(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nanvl(safe_corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("pearson_r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = pairs(df, x, y)
    both = ranked(ranked(rows, "x", "rx"), "y", "ry", rows)
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nanvl(safe_corr("rx", "ry"), F.lit(0.0)), F.lit(0.0)).alias("spearman_rho"))


def outlier_divergence(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = pairs(df, x, y)
    both = ranked(ranked(rows, "x", "rx"), "y", "ry", rows)
    return both.agg(F.abs(safe_corr("x", "y") - safe_corr("rx", "ry")).alias("divergence"))


def two_groups(df: DataFrame, group: str, value: str, reference: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).select((F.col(group).cast("string") == reference).cast("int").alias("a"), F.col(value).cast("double").alias("v")).where("v is not null")


def cliffs_delta(df: DataFrame, group: str, value: str, reference: str) -> DataFrame:
    """2U / (n_a n_b) - 1 of the reference group against the rest, from mid-ranks."""
    r = ranked(two_groups(df, group, value, reference), "v", "r")
    sums = r.agg(F.sum("a").cast("double").alias("na"), F.sum(1 - F.col("a")).cast("double").alias("nb"), F.sum(F.when(F.col("a") == 1, F.col("r"))).alias("ra"))
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    return sums.select(F.col("na").cast("long").alias("n_reference"), F.col("nb").cast("long").alias("n_other"), (F.try_divide(2 * u, F.col("na") * F.col("nb")) - 1).alias("cliffs_delta"))


def hedges_g(df: DataFrame, group: str, value: str, reference: str) -> DataFrame:
    m = two_groups(df, group, value, reference).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    at = lambda k, c: F.max(F.when(F.col("a") == k, F.col(c)))
    w = m.agg(at(1, "n").alias("n1"), at(0, "n").alias("n0"), at(1, "mean").alias("m1"), at(0, "mean").alias("m0"), at(1, "var").alias("v1"), at(0, "var").alias("v0"))
    n = F.col("n1") + F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (n - 2))
    return w.select(n.alias("n"), ((1 - 3 / (4 * n - 9)) * (F.col("m1") - F.col("m0")) / pooled).alias("hedges_g"))


def group_values(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, groups, tie-corrected H and epsilon squared = H / (n - 1), clipped to [0, 1]."""
    rows = group_values(df, group, value)
    r = ranked(rows, "v", "r")
    sums = r.groupBy("g").agg(F.sum("r").alias("sr"), F.count(F.lit(1)).cast("double").alias("m"))
    ties = rows.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    h = sums.agg(F.sum(F.col("sr") * F.col("sr") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups")).withColumn("one", F.lit(0))
    out = h.join(F.broadcast(ties.withColumn("one", F.lit(0))), "one")
    n = F.col("n")
    spread = 1 - F.try_divide(F.col("ties"), F.pow(n, F.lit(3)) - n)
    corrected = F.coalesce(F.try_divide(12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), spread), F.lit(0.0))
    return out.select(n.cast("long").alias("n"), "groups", corrected.alias("kruskal_h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(corrected, n - 1), F.lit(0.0)))).alias("epsilon_squared"))


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the sum of squares, from group moments."""
    m = group_values(df, group, value).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    w = m.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), grand.alias("grand"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("raw"), F.sum(F.col("n") * F.col("var")).alias("within"))
    between = F.col("raw") - F.col("n") * F.col("grand") * F.col("grand")
    return w.select("n", "groups", F.coalesce(F.try_divide(between, between + F.col("within")), F.lit(0.0)).alias("eta_squared"), between.alias("between"), "within")


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """F of a one-way analysis of variance; the p-value comes from one row on the driver."""
    w = eta_squared(df, group, value)
    return w.select("n", "groups", F.try_divide(F.try_divide(F.col("between"), F.col("groups") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("groups"))).alias("f_stat"))


def with_p(stat: DataFrame, test: str) -> DataFrame:
    """A one-row statistic with its p-value."""
    row = stat.first()
    p = {
        "f": lambda: f_sf(row["f_stat"], row["groups"] - 1, row["n"] - row["groups"]),
        "t": lambda: t_two_sided(row["t_stat"], row["dof"]),
        "chi2": lambda: chi2_sf(row["chi_square"], row["dof"]),
    }[test]()
    return stat.withColumn("p_value", F.lit(float(p)))


def welch_t(df: DataFrame, group: str, value: str, reference: str) -> DataFrame:
    m = two_groups(df, group, value, reference).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    at = lambda k, c: F.max(F.when(F.col("a") == k, F.col(c)))
    w = m.agg(at(1, "mean").alias("m1"), at(0, "mean").alias("m0"), (at(1, "var") / at(1, "n")).alias("e1"), (at(0, "var") / at(0, "n")).alias("e0"), at(1, "n").alias("n1"), at(0, "n").alias("n0"))
    e = F.col("e1") + F.col("e0")
    dof = F.try_divide(e * e, F.try_divide(F.col("e1") * F.col("e1"), F.col("n1") - 1) + F.try_divide(F.col("e0") * F.col("e0"), F.col("n0") - 1))
    return w.select(F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(e)).alias("t_stat"), dof.alias("dof"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ra, rb, observed, expected) of every cell, zeros too; windows run over the levels' table."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("ra"), F.col(b).cast("string").alias("rb")).agg(F.count(F.lit(1)).alias("k"))
    left = rows.groupBy("ra").agg(F.sum("k").alias("na"), F.collect_list(F.struct("rb", "k")).alias("own"))
    right = rows.groupBy("rb").agg(F.sum("k").alias("nb")).agg(F.array_sort(F.collect_list(F.struct("rb", "nb"))).alias("levels"), F.sum("nb").alias("n")).withColumn("one", F.lit(0))
    grid = left.withColumn("one", F.lit(0)).join(F.broadcast(right), "one").select("ra", "na", "own", "n", F.explode("levels").alias("c"))
    own = F.coalesce(F.get(F.filter("own", lambda x: x["rb"] == F.col("c.rb")), F.lit(0))["k"], F.lit(0))
    return grid.select("ra", F.col("c.rb").alias("rb"), own.alias("observed"), (F.col("na") * F.col("c.nb") / F.col("n")).alias("expected"), "n")


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """n, dof, chi-square (Yates at 2 x 2) and Cramer's V (never Yates)."""
    cells = contingency(df, a, b)
    gap = F.col("observed") - F.col("expected")
    sums = cells.agg(
        F.max("n").alias("n"), F.count_distinct("ra").alias("rows"), F.count_distinct("rb").alias("cols"), F.sum(gap * gap / F.col("expected")).alias("plain"),
        F.sum(F.pow(F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), F.lit(2)) / F.col("expected")).alias("corrected"),
    )
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    k = F.least("rows", "cols")
    return sums.select("n", dof.alias("dof"), F.when((dof == 1) & F.lit(yates), F.col("corrected")).otherwise(F.col("plain")).alias("chi_square"), k.alias("table_k"), F.sqrt(F.try_divide(F.col("plain"), F.col("n") * (k - 1))).alias("cramers_v"))


def row_pairs(df: DataFrame, x: str, y: str, row_id: str, most: int = PAIR_ROWS) -> DataFrame:
    """All row pairs i < j of a short series; a longer one is refused (compare its period means instead).

    The series is bounded by ``most`` rows, and each row meets the later ones inside its own array.
    """
    rows = df.select(F.col(row_id).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: compare period means")
    series = rows.agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("s"))
    first = series.select("s", F.posexplode("s").alias("at", "p"))
    return first.select("p", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("q")).select(
        F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")
    )


def kendall_tau_b(df: DataFrame, x: str, y: str, row_id: str) -> DataFrame:
    sx, sy = F.signum(F.col("x2") - F.col("x1")), F.signum(F.col("y2") - F.col("y1"))
    w = row_pairs(df, x, y, row_id).agg(F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"), F.count(F.lit(1)).alias("pairs"))
    return w.select("pairs", F.coalesce(F.when(F.col("nx") * F.col("ny") > 0, F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))), F.lit(0.0)).alias("tau_b"))


def sens_slope(df: DataFrame, x: str, y: str, row_id: str) -> DataFrame:
    slopes = row_pairs(df, x, y, row_id).where("x2 <> x1").select(((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"))
    return slopes.agg(F.count(F.lit(1)).alias("pairs"), F.percentile("slope", 0.5).alias("sens_slope"))


def relative_change(df: DataFrame, value: str, now: Column, before: Column) -> DataFrame:
    w = df.agg(F.avg(F.when(now, F.col(value).cast("double"))).alias("m1"), F.avg(F.when(before, F.col(value).cast("double"))).alias("m0"))
    return w.select(F.when(F.col("m0") != 0, (F.col("m1") - F.col("m0")) / F.abs("m0")).alias("relative_change"))


def partial_rank(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of x and y, and that of the residuals of their ranks on the control's ranks."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z")).dropna()
    r = rows
    for c in "xyz":
        r = ranked(r, c, f"r{c}", rows)
    c = r.agg(F.count(F.lit(1)).alias("n"), safe_corr("rx", "ry").alias("xy"), safe_corr("rx", "rz").alias("xz"), safe_corr("ry", "rz").alias("yz"))
    left = 1 - F.col("xz") * F.col("xz")
    right = 1 - F.col("yz") * F.col("yz")
    return c.select("n", F.col("xy").alias("raw"), F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt(F.greatest(left * right, F.lit(0.0)))).alias("partial"), F.col("xz").alias("control_x"), F.col("yz").alias("control_y"))


def rank_matrix(df: DataFrame, columns: list[str], least: int = SCAN.rows) -> DataFrame:
    """(a, b, n, rho) of all column pairs with enough rows.

    Without nulls every column is ranked once and one aggregation gives all pairs; with nulls each pair ranks its own rows.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    duos = list(combinations(columns, 2))
    if all(row[c] == row["n"] for c in columns):
        r = rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        for c in columns:
            r = ranked(r, c, f"rank_{c}", rows)
        wide = r.agg(F.count(F.lit(1)).alias("n"), *[safe_corr(f"rank_{a}", f"rank_{b}").alias(f"p{i}") for i, (a, b) in enumerate(duos)])
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n").alias("n"), F.coalesce(F.nanvl(F.col(f"p{i}"), F.lit(0.0)), F.lit(0.0)).alias("rho")) for i, (a, b) in enumerate(duos)]
        out = wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    else:
        out = None
        for a, b in duos:
            one = spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.col("spearman_rho").alias("rho"))
            out = one if out is None else out.unionByName(one)
    return out.where(F.col("n") >= least)


def scan_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    return rank_matrix(df, columns).withColumn("position", F.row_number().over(Window.orderBy(F.abs("rho").desc(), "a", "b")))


def lag1_autocorrelation(df: DataFrame, value: str, order: str, *partition: str) -> DataFrame:
    """Sum of products of neighbours over the sum of squares, around the mean of each series."""
    by = Window.partitionBy(*partition).orderBy(order)
    centred = df.withColumn("d", F.col(value) - F.avg(value).over(whole(*partition) if partition else everything()))
    paired = centred.withColumn("back", F.lag("d").over(by))
    return paired.groupBy(*partition).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.sum(F.col("d") * F.col("back")), F.sum(F.col("d") * F.col("d"))), F.lit(0.0)).alias("lag1"))


def first_differences(df: DataFrame, value: str, order: str, *partition: str) -> DataFrame:
    return df.withColumn("difference", F.col(value) - F.lag(value).over(Window.partitionBy(*partition).orderBy(order)))


def group_quantiles(rows: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(g, and a column per quantile) of rows (g, v)."""
    out = None
    for name, q in quantiles.items():
        one = exact_quantile(rows, "v", q, ["g"], name).select("g", name)
        out = one if out is None else out.join(one, "g")
    return out


def compare_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, median and quartiles per group."""
    rows = group_values(df, group, value)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    return sizes.join(group_quantiles(rows, {"q25": 0.25, "median": 0.5, "q75": 0.75}), "g").select("g", "n", "mean", "q25", "median", "q75")


def fitted_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return pairs(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def scatter_points(df: DataFrame, x: str, y: str, most: int = 600) -> DataFrame:
    """At most ``most`` points, evenly spaced in the order of x, then y; rows are numbered by distinct x."""
    p = pairs(df, x, y)
    upto = running_total(p.groupBy("x").agg(F.count(F.lit(1)).alias("m")), "x", "m").select(F.col("x").alias("x0"), (F.col("upto") - F.col("m")).alias("before"))
    placed = p.join(upto, F.col("x") == F.col("x0")).withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("x").orderBy("y")))
    sized = placed.crossJoin(F.broadcast(p.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).alias("step"))))
    return sized.where((F.col("rn") - 1) % F.col("step") == 0).select("x", "y")


def box_summary(df: DataFrame, group: str, value: str, most: int = 12) -> DataFrame:
    """n, ends, quartiles and median of the ``most`` largest groups; the window runs over one row per group."""
    rows = group_values(df, group, value)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    kept = sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("n").desc(), "g"))).where(F.col("rn") <= most).drop("rn")
    shown = rows.join(F.broadcast(kept.select("g")), "g", "left_semi")
    return kept.join(group_quantiles(shown, {"q25": 0.25, "median": 0.5, "q75": 0.75}), "g").select("g", "n", "low", "q25", "median", "q75", "high")


def quartile_strata(df: DataFrame, value: str, name: str = "stratum", parts: int = 4) -> DataFrame:
    """``df`` with the quantile group 0 .. parts - 1 of a value: groups close above, equal cuts are merged, null stays null."""
    cuts = sorted({row["quantile"] for i in range(1, parts) if (row := exact_quantile(df, value, i / parts).first()) is not None})
    v = F.col(value).cast("double")
    place = sum([(v > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    return df.withColumn(name, F.when(v.isNotNull(), place))


def group_link(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n, groups and the share of the ranks' variance that lies between groups (eta squared of ranks)."""
    rows = group_values(df, group, value)
    r = ranked(rows, "v", "r").select("g", "r")
    return eta_squared(r, "g", "r").select("n", "groups", F.col("eta_squared").alias("rank_eta_squared"))


def seasonal_range(df: DataFrame, value: str, ordinal: str, year: int = 12) -> DataFrame:
    """One row: the spread of the positions' mean values over the mean of them all, and the positions of both ends."""
    rows = df.where(F.col(value).isNotNull() & F.col(ordinal).isNotNull()).select((F.col(ordinal) % year + 1).cast("int").alias("position"), F.col(value).cast("double").alias("v"))
    means = rows.groupBy("position").agg(F.avg("v").alias("mean"))
    ends = means.agg(F.count(F.lit(1)).alias("positions"), F.max("mean").alias("high"), F.min("mean").alias("low"), F.avg("mean").alias("centre"),
                     F.min_by("position", F.struct(-F.col("mean"), "position")).alias("peak"), F.min_by("position", F.struct("mean", "position")).alias("trough"))
    return ends.where("positions >= 2").select("positions", "peak", "trough", F.when(F.col("centre") != 0, (F.col("high") - F.col("low")) / F.abs("centre")).alias("seasonal_range"))


def latest_absolute_change(df: DataFrame, value: str, ordinal: str) -> DataFrame:
    """One row: the mean of the last period less that of the period before, in the value's unit."""
    means = df.where(F.col(value).isNotNull() & F.col(ordinal).isNotNull()).groupBy(F.col(ordinal).alias("o")).agg(F.avg(F.col(value).cast("double")).alias("m"))
    last = means.agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("o", "m")))), 1, 2).alias("s"))  # one row per period of the calendar
    return last.where(F.size("s") == 2).select(F.col("s")[0]["o"].alias("latest"), F.col("s")[1]["o"].alias("before"), (F.col("s")[0]["m"] - F.col("s")[1]["m"]).alias("absolute_change"))


def gaps_filled(df: DataFrame, value: str, ordinal: str, *partition: str) -> DataFrame:
    """(partition, ordinal, value, filled): every period between a series' first and last, missing values on the line
    between their neighbours.  A window holds one series, as long as the calendar."""
    key = list(partition)
    known = df.where(F.col(value).isNotNull() & F.col(ordinal).isNotNull()).select(*key, F.col(ordinal).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    by = Window.partitionBy(*key).orderBy("o")
    after = known.withColumns({"o2": F.lead("o").over(by), "v2": F.lead("v").over(by)})
    steps = F.sequence("o", F.coalesce(F.col("o2") - 1, F.col("o")))
    spread = after.select(*key, "o", "v", "o2", "v2", F.explode(steps).alias("at"))
    share = F.coalesce((F.col("at") - F.col("o")) / (F.col("o2") - F.col("o")), F.lit(0.0))
    line = F.col("v") + F.coalesce(F.col("v2") - F.col("v"), F.lit(0.0)) * share
    return spread.select(*key, F.col("at").alias(ordinal), line.alias(value), (F.col("at") > F.col("o")).alias("filled"))
