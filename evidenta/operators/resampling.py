"""Permutation tests and bootstrap intervals.

Randomness is the order of a hash of (seed, resample, row), so a test has one result on any partitioning and in any
engine.  Ranks are taken once: a permutation of values permutes their ranks, so a resample costs one sum of products.
A p-value is (1 + extreme resamples) / (resamples + 1), two-sided with a tolerance of 1e-12.

``*_test`` functions run as DataFrame operations.  ``fast_rank_test`` spreads resamples of a short series over Python
workers with NumPy, for the production count of resamples; ``spread_rank_test`` spreads the rows, for whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.scalars import everything, mid_rank, money, safe_corr, seeded
from evidenta.operators.association import ranked
from evidenta.plans.config import GATE
from evidenta.runtime import ship

TOLERANCE = 1e-12


def replicated(rows: DataFrame, resamples: int) -> DataFrame:
    """Each row once per resample b, generated where the row stands."""
    return rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))


def p_value(observed: DataFrame, resampled: DataFrame, statistic: str = "stat") -> DataFrame:
    """(statistic, resamples, extreme, p_value) from one observed row and one row per resample."""
    seen = observed.select(F.col(statistic).alias("observed"), F.lit(0).alias("one"))
    flags = resampled.withColumn("one", F.lit(0)).join(F.broadcast(seen), "one")
    counted = flags.groupBy("observed").agg(
        F.count(F.lit(1)).alias("resamples"), F.count_if(F.abs(statistic) >= F.abs("observed") - TOLERANCE).alias("extreme")
    )
    return counted.withColumn("p_value", (F.col("extreme") + 1) / (F.col("resamples") + 1)).withColumnRenamed("observed", "statistic")


#: Rows that a test by shuffled places takes: each resample orders all rows of a stratum once, in one task.
PLACED_ROWS = 2_000_000
#: Rows that travel as one array, and replicated rows that a task orders (whole resamples).
PIECE, TASK_ROWS = 4096, 500_000


def numbered(df: DataFrame, row_id: str, stratum: list[str] | None = None) -> DataFrame:
    """``i``: the row's place in the order of its id (within its stratum).

    Tests by shuffled places are for the rows of one claim's confirmation sample; a larger one is refused, not cut
    (``spread_rank_test`` takes whole tables).
    """
    if (n := df.limit(PLACED_ROWS + 1).count()) > PLACED_ROWS:
        raise ValueError(f"more than {PLACED_ROWS} rows ({n}): use spread_rank_test")
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*(stratum or [F.lit(0)])).orderBy(row_id)))


def shuffled(rows: DataFrame, resamples: int, seed: int, row_id: str, stratum: list[str] | None = None) -> DataFrame:
    """Every resample's rows with a place ``j``: a random permutation of the places (within each stratum).

    A task draws whole resamples from the sample, which it gets as arrays: replicated rows are neither moved between
    tasks nor gathered in one.
    """
    spark, n = rows.sparkSession, rows.count()
    tasks = min(resamples, max(spark.sparkContext.defaultParallelism, -(-n * resamples // TASK_ROWS)))
    piece = F.pmod(F.xxhash64(row_id), F.lit(-(-n // PIECE) or 1))
    pieces = rows.groupBy(piece.alias("piece")).agg(F.collect_list(F.struct(*rows.columns)).alias("held")).select("held")
    copies = spark.range(0, resamples, 1, tasks).withColumnRenamed("id", "b").crossJoin(F.broadcast(pieces)).select("b", F.inline("held"))
    by = Window.partitionBy("b", *(stratum or [])).orderBy("draw", row_id)
    return copies.withColumn("draw", seeded(seed, F.col("b"), F.col(row_id))).withColumn("j", F.row_number().over(by)).drop("draw")


def waiting(moved: DataFrame, placed: DataFrame, columns: list[str], stratum: list[str] | None = None) -> DataFrame:
    """``moved`` with the ``columns`` of the row whose place ``i`` (in the same stratum) is its ``j``.

    The sample is the side that is broadcast, as arrays of PIECE rows.  A planner that chose would take the replicated
    rows for as few as the sample's, and could send them to the driver.
    """
    keys = [F.col(c).alias(f"at_{c}") for c in stratum or []]
    piece = lambda place: F.floor((F.col(place) - 1) / PIECE).cast("int")
    held = placed.groupBy(*keys, piece("i").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("held"))
    base = held.select(*[f"at_{c}" for c in stratum or []], "piece", *[F.col("held")[c].alias(f"at_{c}") for c in columns])
    same = [F.col(c) == F.col(f"at_{c}") for c in stratum or []]
    found = moved.join(F.broadcast(base), [*same, piece("j") == F.col("piece")])
    return found.select(*moved.columns, *[F.get(F.col(f"at_{c}"), (F.col("j") - 1) % PIECE).alias(c) for c in columns])


def _rank_moments(r: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    return r.agg(n.alias("n"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))


def _rho(total: Column) -> Column:
    """Rank correlation from a sum of rank products; 0 for a constant column."""
    return F.coalesce(F.when(F.col("sx") * F.col("sy") > 0, F.round((total / F.col("n") - F.col("mx") * F.col("my")) / (F.col("sx") * F.col("sy")), 12)), F.lit(0.0))


def correlation_test(df: DataFrame, x: str, y: str, row_id: str, resamples: int, seed: int = GATE.seed, stratum: str | None = None) -> DataFrame:
    """Rank correlation against free shuffles of y, or shuffles within strata (the statistic is always the overall one)."""
    keep = [F.col(row_id).alias("rid"), (F.col(stratum) if stratum else F.lit(0)).alias("stratum")]
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *keep).where("x is not null and y is not null")
    r = ranked(ranked(rows, "x", "rx"), "y", "ry", rows)
    placed = numbered(r, "rid", ["stratum"]).select("rid", "stratum", "i", "rx", "ry").persist()
    moments = F.broadcast(_rank_moments(placed).withColumn("one", F.lit(0)))
    seen = placed.agg(F.sum(F.col("rx") * F.col("ry")).alias("t")).withColumn("one", F.lit(0)).join(moments, "one").select(_rho(F.col("t")).alias("stat"))
    within = ["stratum"] if stratum else []
    moved = shuffled(placed.select("rid", *within, "ry"), resamples, seed, "rid", within)
    sums = waiting(moved, placed, ["rx"], within).groupBy("b").agg(F.sum(F.col("rx") * F.col("ry")).alias("t"))
    drawn = sums.withColumn("one", F.lit(0)).join(moments, "one").select("b", _rho(F.col("t")).alias("stat"))
    return p_value(seen, drawn)


def _delta(rank_sum: Column) -> Column:
    u = rank_sum - F.col("na") * (F.col("na") + 1) / 2
    return F.round(2 * u / (F.col("na") * F.col("nb")) - 1, 12)


def group_test(df: DataFrame, group: str, value: str, reference: str, row_id: str, resamples: int, seed: int = GATE.seed, stratum: str | None = None) -> DataFrame:
    """Cliff's delta of the reference group against labels that move freely, or within strata; group sizes stay."""
    keep = [F.col(row_id).alias("rid"), (F.col(stratum) if stratum else F.lit(0)).alias("stratum")]
    rows = df.select((F.col(group).cast("string") == reference).cast("int").alias("a"), F.col(value).cast("double").alias("v"), *keep).where("a is not null and v is not null")
    placed = numbered(ranked(rows, "v", "r"), "rid", ["stratum"]).select("rid", "stratum", "i", "a", "r").persist()
    sizes = F.broadcast(placed.agg(F.sum("a").cast("double").alias("na"), F.sum(1 - F.col("a")).cast("double").alias("nb")).withColumn("one", F.lit(0)))
    seen = placed.agg(F.sum(F.col("a") * F.col("r")).alias("t")).withColumn("one", F.lit(0)).join(sizes, "one").select(_delta(F.col("t")).alias("stat"))
    within = ["stratum"] if stratum else []
    moved = shuffled(placed.select("rid", *within, "a"), resamples, seed, "rid", within).where("a = 1")
    sums = waiting(moved, placed, ["r"], within).groupBy("b").agg(F.sum("r").alias("t"))
    return p_value(seen, sums.withColumn("one", F.lit(0)).join(sizes, "one").select("b", _delta(F.col("t")).alias("stat")))


def cluster_test(df: DataFrame, group: str, value: str, reference: str, entity: str, resamples: int, seed: int = GATE.seed) -> DataFrame:
    """Cliff's delta against labels that move between whole entities; a label that varies inside an entity is refused."""
    rows = df.select((F.col(group).cast("string") == reference).cast("int").alias("a"), F.col(value).cast("double").alias("v"), F.col(entity).alias("e")).where("a is not null and v is not null and e is not null")
    r = ranked(rows, "v", "r")
    units = r.groupBy("e").agg(F.min("a").alias("a"), F.max("a").alias("a2"), F.sum("r").alias("sr"), F.count(F.lit(1)).cast("double").alias("m")).persist()
    if units.where("a <> a2").limit(1).count():
        raise ValueError("the group varies inside an entity")
    placed = numbered(units, "e").select("e", "i", "a", "sr", "m").persist()
    total = placed.agg(F.sum("m").alias("n")).withColumn("one", F.lit(0))

    def delta(sums: DataFrame) -> DataFrame:
        sized = sums.withColumn("one", F.lit(0)).join(F.broadcast(total), "one")
        return sized.withColumn("nb", F.col("n") - F.col("na")).withColumn("stat", _delta(F.col("t")))

    mark = F.sum(F.when(F.col("a") == 1, F.col("sr"))).alias("t"), F.sum(F.when(F.col("a") == 1, F.col("m"))).alias("na")
    moved = shuffled(placed.select("e", "a"), resamples, seed, "e").where("a = 1").select("b", "j")
    sums = waiting(moved, placed, ["sr", "m"]).groupBy("b").agg(F.sum("sr").alias("t"), F.sum("m").alias("na"))
    return p_value(delta(placed.agg(*mark)).select("stat"), delta(sums).select("b", "stat"))


def last_two_periods(df: DataFrame, ordinal: str) -> list:
    """The latest period and the one before; at most two values reach the driver."""
    return [r[0] for r in df.where(F.col(ordinal).isNotNull()).select(ordinal).distinct().orderBy(F.col(ordinal).desc()).limit(2).collect()]


def paired_change_test(df: DataFrame, value: str, entity: str, ordinal: str, resamples: int, seed: int = GATE.seed, least: int = 4) -> DataFrame:
    """Relative change of the entities' means between the last two periods against random signs per entity."""
    now, before = last_two_periods(df, ordinal)
    at = lambda p: F.avg(F.when(F.col(ordinal) == p, F.col(value).cast("double")))
    steps = df.groupBy(F.col(entity).alias("e")).agg(at(now).alias("v1"), at(before).alias("v0")).where("v1 is not null and v0 is not null")
    steps = steps.withColumn("step", F.col("v1") - F.col("v0")).withColumn("n", F.count(F.lit(1)).over(everything())).where(F.col("n") >= least).persist()
    scale = F.broadcast(steps.agg(F.avg("v0").alias("m0"), F.count(F.lit(1)).alias("k")).withColumn("one", F.lit(0)))
    stat = F.round(F.col("t") / F.col("k") / F.abs("m0"), 12)
    seen = steps.agg(F.sum("step").alias("t")).withColumn("one", F.lit(0)).join(scale, "one").select(stat.alias("stat"))
    flip = F.when(F.conv(F.substring(seeded(seed, F.col("b"), F.col("e")), 1, 1), 16, 10).cast("int") >= 8, -1.0).otherwise(1.0)
    drawn = replicated(steps, resamples).groupBy("b").agg(F.sum(flip * F.col("step")).alias("t")).withColumn("one", F.lit(0)).join(scale, "one").select("b", stat.alias("stat"))
    return p_value(seen, drawn)


def unpaired_change_test(df: DataFrame, value: str, ordinal: str, row_id: str, resamples: int, seed: int = GATE.seed) -> DataFrame:
    """Relative change of means between the last two periods against rows that move between them."""
    now, before = last_two_periods(df, ordinal)
    rows = df.where(F.col(ordinal).isin(now, before) & F.col(value).isNotNull())
    rows = rows.select(F.col(row_id).alias("rid"), (F.col(ordinal) == now).cast("int").alias("a"), money(F.col(value)).alias("v"))
    placed = numbered(rows, "rid").select("rid", "i", "a", "v").persist()
    sizes = F.broadcast(placed.agg(F.sum("a").alias("n1"), F.sum(1 - F.col("a")).alias("n0"), F.sum("v").cast("double").alias("all")).withColumn("one", F.lit(0)))

    def change(sums: DataFrame) -> DataFrame:
        sized = sums.withColumn("one", F.lit(0)).join(sizes, "one")
        rest = (F.col("all") - F.col("t")) / F.col("n0")
        return sized.withColumn("stat", F.round((F.col("t") / F.col("n1") - rest) / F.abs(rest), 12))

    total = F.sum("v").cast("double").alias("t")
    moved = shuffled(placed.select("rid", "a"), resamples, seed, "rid").where("a = 1").select("b", "j")
    sums = waiting(moved, placed, ["v"]).groupBy("b").agg(total)
    return p_value(change(placed.where("a = 1").agg(total)).select("stat"), change(sums).select("b", "stat"))


def latest_change_test(df: DataFrame, value: str, ordinal: str, row_id: str, resamples: int, entity: str | None = None, seed: int = GATE.seed) -> DataFrame:
    """The change of the last two periods: paired by entity where there is one, else rows against rows."""
    if entity:
        return paired_change_test(df, value, entity, ordinal, resamples, seed)
    return unpaired_change_test(df, value, ordinal, row_id, resamples, seed)


def drawn_units(units: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, unit): every resample draws as many units as there are, by the hash of (seed, resample, draw)."""
    placed = numbered(units.select("unit").distinct(), "unit").persist()
    n = placed.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(0))
    draws = replicated(placed.select(F.col("i").alias("k")), resamples).withColumn("one", F.lit(0)).join(F.broadcast(n), "one")
    head = F.conv(F.substring(seeded(seed, F.col("b"), F.col("k")), 1, 8), 16, 10).cast("long")
    return draws.select("b", "k", (F.pmod(head, F.col("n")) + 1).cast("int").alias("j")).join(placed, F.col("j") == F.col("i")).select("b", "k", "unit")


def effect_interval(df: DataFrame, x: str, y: str, unit: str, resamples: int = GATE.interval_resamples, seed: int = GATE.seed, level: float = GATE.level, least_valid: float = 0.8) -> DataFrame:
    """Percentile interval of a rank correlation; the resampled unit (row, entity or period) follows the test's null.

    Ranks are taken again in every resample.  Null where fewer than 80 % of the resamples have an effect.
    """
    rows = df.select(F.col(unit).alias("unit"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().persist()
    picked = drawn_units(rows, resamples, seed).join(rows, "unit")
    r = picked.withColumn("rx", mid_rank(F.col("x"), "b")).withColumn("ry", mid_rank(F.col("y"), "b"))
    effects = r.groupBy("b").agg(F.round(F.nanvl(safe_corr("rx", "ry"), F.lit(None).cast("double")), 9).alias("e"))
    half = (1 - level) / 2
    out = effects.agg(F.count(F.lit(1)).alias("resamples"), F.count("e").alias("valid"), F.percentile("e", half).alias("low"), F.percentile("e", 1 - half).alias("high"))
    enough = F.col("valid") >= least_valid * F.col("resamples")
    return out.withColumns({"low": F.when(enough, F.col("low")), "high": F.when(enough, F.col("high"))})


def bootstrap_mean(df: DataFrame, value: str, row_id: str, resamples: int, seed: int = GATE.seed, level: float = GATE.level) -> DataFrame:
    """Percentile interval of a mean: every resample draws n rows by the hash of (seed, resample, draw)."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(row_id).alias("rid"), F.col(value).cast("double").alias("v")), "rid").select("rid", "i", "v").persist()
    n = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(0))
    draws = replicated(rows.select(F.col("i").alias("k")), resamples).withColumn("one", F.lit(0)).join(F.broadcast(n), "one")
    head = F.conv(F.substring(seeded(seed, F.col("b"), F.col("k")), 1, 8), 16, 10).cast("long")
    picked = draws.withColumn("j", (F.pmod(head, F.col("n")) + 1).cast("int")).join(rows.select("i", "v"), F.col("j") == F.col("i"))
    means = picked.groupBy("b").agg(F.round(F.avg("v"), 9).alias("m"))
    half = (1 - level) / 2
    return means.agg(F.count(F.lit(1)).alias("resamples"), F.percentile("m", half).alias("low"), F.percentile("m", 1 - half).alias("high"))


def benjamini_hochberg(claims: DataFrame, p: str = "p_value", claim_id: str = "claim_id") -> DataFrame:
    """q-values of one family: the least n / rank * p from here on, clipped at 1; ties of p share the later one's q."""
    rn = F.row_number().over(Window.orderBy(p, claim_id))
    placed = claims.withColumn("rn", rn).withColumn("family", F.count(F.lit(1)).over(everything()))
    onward = F.min(F.col(p) * F.col("family") / F.col("rn")).over(Window.orderBy(F.col("rn").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("q_value", F.least(F.lit(1.0), onward)).drop("rn")


def rejections(corrected: DataFrame, alpha: float = GATE.alpha) -> DataFrame:
    return corrected.where(F.col("q_value") < alpha)


CHUNK = 250
#: Rows of a claim that ``fast_rank_test`` brings to the driver and sends to each task (a few MB).
FAST_ROWS = 200_000


def fast_rank_test(df: DataFrame, x: str, y: str, resamples: int = GATE.resamples, seed: int = GATE.seed, kind: str = "correlation", reference: str | None = None) -> DataFrame:
    """The same test for a short series and many resamples: chunks of resamples over Python workers.

    The series is one claim's rows, at most the rows of a confirmation sample; it is sent to each task, and resample b
    draws from a counter-based generator keyed by (seed, b), so chunking does not change the result.  A table of more than
    FAST_ROWS rows is refused, not cut.
    """
    ship(df.sparkSession)
    known = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rows = known.limit(FAST_ROWS + 1).toPandas()
    if len(rows) > FAST_ROWS:
        raise ValueError(f"more than {FAST_ROWS} rows: use spread_rank_test")
    ry = rows["y"].rank().to_numpy()
    if kind == "correlation":
        rx = rows["x"].astype("float64").rank().to_numpy()
    else:
        rx = (rows["x"].astype(str) == reference).to_numpy().astype(float)
    n, na = len(ry), rx.sum()

    def statistic(totals: np.ndarray) -> np.ndarray:
        if kind == "correlation":
            spread = rx.std() * ry.std()
            return (totals / n - rx.mean() * ry.mean()) / spread if spread > 0 else np.zeros_like(totals)
        return 2 * (totals - na * (na + 1) / 2) / (na * (n - na)) - 1

    observed = float(statistic(np.array([float(rx @ ry)]))[0])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for chunk in part["id"]:
                extreme = 0
                count = min(CHUNK, resamples - chunk * CHUNK)
                rng = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, int(chunk)]))
                order = rng.permuted(np.tile(rx.astype(np.float32), (count, 1)), axis=1)
                extreme += int((np.abs(statistic(order @ ry)) >= abs(observed) - 1e-7).sum())
                yield pd.DataFrame({"resamples": [count], "extreme": [extreme]})

    chunks = -(-resamples // CHUNK)
    parts = df.sparkSession.range(0, chunks, 1, min(chunks, df.sparkSession.sparkContext.defaultParallelism))
    total = parts.mapInPandas(run, "resamples long, extreme long").agg(F.sum("resamples").alias("resamples"), F.sum("extreme").alias("extreme"))
    return total.select(F.lit(observed).alias("statistic"), "resamples", "extreme", ((F.col("extreme") + 1) / (F.col("resamples") + 1)).alias("p_value"))


#: Rows of a block while the table has few of them, most blocks, and most distinct values of x, which reach the driver.
BLOCK_ROWS, MAX_BLOCKS, MAX_LEVELS = 4096, 4096, 10_000


def _dealt(levels: np.ndarray, sizes: np.ndarray, block: int, seed: int, b: int) -> np.ndarray:
    """How many of each level fall into a block in resample b: halves of the blocks draw without replacement, down to one."""
    low, high, node = 0, len(sizes), 1
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, node], counter=[0, 0, 0, b]))
        left = rng.multivariate_hypergeometric(levels, int(sizes[low:mid].sum()), method="marginals")
        if block < mid:
            levels, high, node = left, mid, 2 * node
        else:
            levels, low, node = levels - left, mid, 2 * node + 1
    return levels


def spread_rank_test(df: DataFrame, x: str, y: str, row_id: str, resamples: int = GATE.resamples, seed: int = GATE.seed) -> DataFrame:
    """Rank correlation of a whole table against free shuffles of an ``x`` with at most MAX_LEVELS distinct values.

    Rows are dealt to blocks by a hash of their id.  In resample b every block draws its share of x's levels (all tasks
    agree on it without talking to each other, see ``_dealt``) and shuffles it over its rows, which is one uniform
    permutation of the table.  Only x's levels and the sizes of the blocks reach the driver.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(row_id).alias("rid")).dropna(subset=["x", "y"])
    r = ranked(ranked(rows, "x", "rx", rows), "y", "ry", rows).select("rid", "rx", "ry").persist()
    found = sorted((v["rx"], v["m"]) for v in r.groupBy("rx").agg(F.count(F.lit(1)).alias("m")).limit(MAX_LEVELS + 1).collect())
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{x} has more than {MAX_LEVELS} distinct values")
    values, levels = np.array([v for v, _ in found], dtype=float), np.array([m for _, m in found], dtype=np.int64)
    blocks = max(1, min(MAX_BLOCKS, -(-int(levels.sum()) // BLOCK_ROWS)))
    placed = r.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, dtype=np.int64)
    for v in placed.groupBy("block").agg(F.count(F.lit(1)).alias("m")).collect():
        sizes[v["block"]] = v["m"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        block, ry = int(part["block"].iloc[0]), np.sort(part["ry"].to_numpy(float))
        sums = np.empty(resamples)
        for b in range(resamples):
            rx = np.repeat(values, _dealt(levels, sizes, block, seed, b))
            rng = np.random.Generator(np.random.Philox(key=[seed, 0], counter=[0, 0, block, b]))
            rng.shuffle(rx)
            sums[b] = rx @ ry
        return pd.DataFrame({"b": np.arange(resamples, dtype=np.int32), "t": sums})

    moments = F.broadcast(_rank_moments(r).withColumn("one", F.lit(0)))
    seen = r.agg(F.sum(F.col("rx") * F.col("ry")).alias("t")).withColumn("one", F.lit(0)).join(moments, "one").select(_rho(F.col("t")).alias("stat"))
    totals = placed.select("block", "ry").groupBy("block").applyInPandas(run, "b int, t double").groupBy("b").agg(F.sum("t").alias("t"))
    return p_value(seen, totals.withColumn("one", F.lit(0)).join(moments, "one").select("b", _rho(F.col("t")).alias("stat")))
