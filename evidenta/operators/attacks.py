"""Attacks on supported claims: each recomputes the effect where a fragile one would break.

An attack returns one row (attack, original, attacked, outcome) with outcome survived, broken or not_run.  A claim's
effect on a subset is always the same function of the subset's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.quantiles import exact_quantile, running_total
from evidenta.functions.scalars import everything, mid_rank, safe_corr, seeded
from evidenta.operators import association as A

TRIM, OUTLIER_Z, SHRINK, SUBGROUP_ROWS, HALF_PERIODS, SUBGROUP_WEIGHT = 0.10, 3.5, 0.5, 30, 8, 0.2
MAX_COLUMNS, MAX_LEVELS, CONFOUND_SCORE, MAX_PROXY, IDENTITY = 3, 10, 0.1, 0.9, 1e-6

Effect = Callable[[DataFrame], DataFrame]


def correlation_effect(x: str, y: str) -> Effect:
    return lambda df: A.spearman(df, x, y).select("n", F.round("spearman_rho", 12).alias("effect"))


def group_effect(group: str, value: str, reference: str) -> Effect:
    return lambda df: A.cliffs_delta(df, group, value, reference).select((F.col("n_reference") + F.col("n_other")).alias("n"), F.round("cliffs_delta", 12).alias("effect"))


def grouped_correlation(df: DataFrame, x: str, y: str, by: Column, name: str = "level") -> DataFrame:
    """(level, n, effect): rank correlation inside every level, ranks taken within it."""
    rows = df.select(by.cast("string").alias(name), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    r = rows.withColumn("rx", mid_rank(F.col("x"), name)).withColumn("ry", mid_rank(F.col("y"), name))
    return r.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.nanvl(safe_corr("rx", "ry"), F.lit(0.0)), F.lit(0.0)), 12).alias("effect"))


def _judged(attack: str, original: DataFrame, attacked: DataFrame) -> DataFrame:
    """Broken by a flipped sign or by less than half of the effect."""
    o = original.select(F.col("effect").alias("original"), F.lit(0).alias("one"))
    a = attacked.select(F.col("effect").alias("attacked"), F.col("n").alias("rows"), F.lit(0).alias("one2"))
    both = o.join(a, F.col("one") == F.col("one2"), "left")
    broken = (F.signum("attacked") == -F.signum("original")) | (F.abs("attacked") < SHRINK * F.abs("original"))
    outcome = F.when(F.col("attacked").isNull(), "not_run").when(broken, "broken").otherwise("survived")
    return both.select(F.lit(attack).alias("attack"), "original", "attacked", "rows", outcome.alias("outcome"))


def robust_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """``extremity``: the largest absolute robust z over the columns."""
    out, scores = df, []
    for c in columns:
        med = exact_quantile(df, c, 0.5).first()
        if med is None:
            continue
        away = df.where(F.col(c).isNotNull()).select(F.abs(F.col(c).cast("double") - F.lit(med["quantile"])).alias("d"))
        mad = exact_quantile(away, "d", 0.5).first()["quantile"]
        scale = 1.4826 * mad if mad > 0 else 1.2533 * (away.agg(F.avg("d")).first()[0] or 0.0)
        if scale > 0:
            scores.append(F.coalesce(F.abs(F.col(c).cast("double") - F.lit(med["quantile"])) / F.lit(scale), F.lit(0.0)))
    return out.withColumn("extremity", F.greatest(F.lit(0.0), *scores) if scores else F.lit(0.0))


def trim(df: DataFrame, effect: Effect, columns: list[str], row_id: str) -> DataFrame:
    """A1: without the rows that are extreme on a claim column, a tenth of all rows at most (the most extreme, then by id).

    Where more rows are extreme, running totals over the distinct scores find the score at which the tenth ends; only
    rows of that very score are ordered.
    """
    scored = robust_scores(df, columns).persist()
    cap = int(TRIM * scored.count())
    far = scored.where(F.col("extremity") > OUTLIER_Z)
    gone = F.col("extremity") > OUTLIER_Z
    if far.count() > cap:
        levels = far.groupBy((-F.col("extremity")).alias("low")).agg(F.count(F.lit(1)).alias("m"))
        row = running_total(levels, "low", "m").where(F.col("upto") > cap).agg(F.min(F.struct("low", "upto", "m")).alias("at")).first()["at"]
        edge = far.where(-F.col("extremity") == F.lit(row["low"])).select(F.col(row_id).alias("edge_id"))
        kept = edge.orderBy("edge_id").limit(cap - row["upto"] + row["m"])
        marked = scored.join(kept, F.col(row_id) == F.col("edge_id"), "left")
        rest = marked.where(~((-F.col("extremity") < F.lit(row["low"])) | F.col("edge_id").isNotNull())).drop("edge_id")
    else:
        rest = scored.where(~gone)
    out = _judged("trim", effect(scored), effect(rest.drop("extremity")))
    return out


def halves(df: DataFrame, effect: Effect, row_id: str, ordinal: str | None = None, seed: int = 1) -> DataFrame:
    """A2: the weaker of the earlier and later periods, or of two halves by a hash."""
    if ordinal:
        periods = sorted(r[0] for r in df.select(ordinal).distinct().dropna().collect())  # as many as the calendar has
        if len(periods) < 2 * HALF_PERIODS:
            return _judged("halves", effect(df), effect(df).limit(0))
        first = F.col(ordinal) < F.lit(periods[len(periods) // 2])
    else:
        first = F.substring(seeded(seed, F.col(row_id)), 1, 1) < "8"
    parts = effect(df.where(first)).unionByName(effect(df.where(~first))).where(F.col("n") >= SUBGROUP_ROWS)
    original = effect(df)
    sign = F.signum("original")
    worst = parts.withColumn("one", F.lit(0)).join(original.select(F.col("effect").alias("original"), F.lit(0).alias("one")), "one")
    least = worst.withColumn("toward", F.col("effect") * sign).agg(F.min_by("n", "toward").alias("n"), F.min_by("effect", "toward").alias("effect"), F.count(F.lit(1)).alias("k")).where("k = 2")
    return _judged("halves", original, least)


def control(df: DataFrame, x: str, y: str, controls: list[str]) -> DataFrame:
    """A3: the partial rank correlation given the control that could confound most."""
    found = None
    for z in controls:
        one = A.partial_rank(df, x, y, z).withColumn("control", F.lit(z))
        found = one if found is None else found.unionByName(one)
    score = F.abs("control_x") * F.abs("control_y")
    able = found.where((score >= CONFOUND_SCORE) & (F.abs("control_x") < MAX_PROXY) & (F.abs("control_y") < MAX_PROXY))
    best = able.withColumn("score", F.round(score, 9)).orderBy(F.col("score").desc(), "control").limit(1)
    return _judged("control", correlation_effect(x, y)(df), best.select("n", F.round("partial", 12).alias("effect")))


def subgroups(df: DataFrame, x: str, y: str, columns: list[str]) -> DataFrame:
    """A4: one row per grouping column: a heavy level that reverses, or a pooled effect that does (Simpson)."""
    original = correlation_effect(x, y)(df).select(F.col("effect").alias("original"), F.col("n").alias("total"), F.lit(0).alias("one"))
    out = None
    for c in columns[:MAX_COLUMNS]:
        levels = grouped_correlation(df.where(F.col(c).isNotNull()), x, y, F.col(c)).withColumn("levels", F.count(F.lit(1)).over(everything()))
        able = levels.where((F.col("n") >= SUBGROUP_ROWS) & F.col("levels").between(2, MAX_LEVELS)).withColumn("one", F.lit(0)).join(F.broadcast(original), "one")
        heavy = (F.col("n") / F.col("total") >= SUBGROUP_WEIGHT) & (F.signum("effect") == -F.signum("original")) & (F.abs("effect") >= SHRINK * F.abs("original"))
        row = able.groupBy("original").agg(
            F.count(F.lit(1)).alias("levels"), F.count_if(heavy).alias("reversed_levels"), F.round(F.sum(F.col("effect") * F.col("n")) / F.sum("n"), 9).alias("pooled_within")
        )
        flips = (F.col("reversed_levels") > 0) | (F.signum("pooled_within") == -F.signum("original"))
        one = row.where("levels >= 2").select(F.lit("subgroups").alias("attack"), F.lit(c).alias("column_name"), "original", "levels", "reversed_levels", "pooled_within", F.when(flips, "broken").otherwise("survived").alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


def alternative(df: DataFrame, x: str, y: str) -> DataFrame:
    """A5: the sign of another statistic of the same association."""
    a = A.pearson(df, x, y).select("n", F.round("pearson_r", 12).alias("effect"))
    o = correlation_effect(x, y)(df)
    out = _judged("alternative", o, a)
    return out.withColumn("outcome", F.when(F.signum("attacked") != F.signum("original"), "broken").otherwise("survived"))


def detrend(df: DataFrame, x: str, y: str, ordinal: str, entity: str | None = None, least: int = 30) -> DataFrame:
    """A6: correlation of period-to-period changes, inside each entity."""
    by = Window.partitionBy(*([entity] if entity else [F.lit(0)])).orderBy(ordinal)
    changes = df.withColumns({"dx": F.round(F.col(x) - F.lag(x).over(by), 6), "dy": F.round(F.col(y) - F.lag(y).over(by), 6)}).where("dx is not null and dy is not null")
    return _judged("detrend", correlation_effect(x, y)(df), correlation_effect("dx", "dy")(changes).where(F.col("n") >= least))


def identity(df: DataFrame, x: str, y: str, others: list[str]) -> DataFrame:
    """A7: y an exact line of x, or the sum or difference of x and a third column; all checked in one aggregation."""
    z = [F.col(o).cast("double") for o in others]
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = [F.max(F.abs(c - b)).alias(f"m{i}_{k}") for i, o in enumerate(z) for k, c in enumerate((a + o, a - o, o - a))]
    row = df.where(a.isNotNull() & b.isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop(b).alias("sd"), safe_corr(a, b).alias("r"), *sums)
    gaps = F.array(*[F.col(f"m{i}_{k}") for i in range(len(z)) for k in range(3)]) if z else F.array().cast("array<double>")
    exact = F.exists(gaps, lambda g: g <= IDENTITY * F.col("sd")) | (F.abs("r") >= 1 - IDENTITY**2)
    return row.select(F.lit("identity").alias("attack"), "rows", F.when(F.coalesce(exact, F.lit(False)), "broken").otherwise("survived").alias("outcome"))


def fragility(proofs: DataFrame, attacks: DataFrame) -> DataFrame:
    """The one-way ratchet: a PASS with a broken attack is fragile; nothing else changes."""
    broken = attacks.where("outcome = 'broken'").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("attack")), ",").alias("broken_by"), F.count(F.lit(1)).alias("broken"))
    out = proofs.join(broken, "claim_id", "left")
    return out.withColumn("standing", F.when((F.col("verdict") == "PASS") & F.col("broken").isNotNull(), "FRAGILE").otherwise(F.col("verdict"))).drop("broken")


def skeptic(df: DataFrame, x: str, y: str, controls: list[str], drop: float = 0.5, link: float = 0.25, proxy: float = 0.9) -> DataFrame:
    """Controls that take at least half of a rank correlation with them, linked to both sides and copies of neither."""
    out = None
    for z in controls:
        one = A.partial_rank(df, x, y, z).select(F.lit(z).alias("control"), "n", "raw", "partial", "control_x", "control_y")
        out = one if out is None else out.unionByName(one)
    linked = (F.abs("control_x") >= link) & (F.abs("control_y") >= link) & (F.abs("control_x") < proxy) & (F.abs("control_y") < proxy)
    return out.withColumn("caveat", linked & (F.abs("partial") <= (1 - drop) * F.abs("raw")) & (F.abs("raw") >= 0.1) & (F.col("n") >= 30))
