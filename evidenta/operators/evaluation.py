"""Scoring of claims against planted truth, the store of verified lessons and its vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_LESSONS, MIN_SIMILARITY = 5, 0.35


def pair_key(a: str, b: str) -> Column:
    return F.concat_ws("|", F.array_sort(F.array(F.col(a), F.col(b))))


def match_truth(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Every claim with the label of its dataset, pair and type; a wrong direction does not match.

    A group difference read from the other reference group has the opposite direction.
    """
    left = claims.withColumn("pair", pair_key("var_a", "var_b"))
    right = truth.select("dataset", pair_key("var_a", "var_b").alias("pair"), F.col("claim_type"), "label", F.col("direction").alias("true_direction"), F.col("reference_group").alias("true_reference"), "level")
    both = left.join(right, ["dataset", "pair", "claim_type"], "left")
    flip = (F.col("claim_type") == "group_difference") & (F.col("reference_group") != F.col("true_reference"))
    seen = F.when(F.coalesce(flip, F.lit(False)), F.when(F.col("direction") == "positive", "negative").when(F.col("direction") == "negative", "positive")).otherwise(F.col("direction"))
    agrees = F.coalesce(seen == F.col("true_direction"), F.lit(True))
    return both.withColumn("is_true", F.coalesce((F.col("label") == "injected") & agrees, F.lit(False))).drop("pair")


def score(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Per dataset: reported, true and false reports, precision, recall and false discovery proportion (0 without reports)."""
    hits = matched.groupBy("dataset").agg(F.count(F.lit(1)).alias("reported"), F.sum(F.col("is_true").cast("long")).alias("true_reports"))
    planted = truth.where("label = 'injected'").groupBy("dataset").agg(F.count(F.lit(1)).alias("planted"))
    base = truth.select("dataset").distinct().join(hits, "dataset", "left").join(planted, "dataset", "left").na.fill(0, ["reported", "true_reports", "planted"])
    return base.select(
        "dataset", "reported", "true_reports", "planted", F.when(F.col("reported") > 0, F.col("true_reports") / F.col("reported")).alias("precision"),
        F.when(F.col("planted") > 0, F.col("true_reports") / F.col("planted")).alias("recall"),
        F.when(F.col("reported") > 0, 1 - F.col("true_reports") / F.col("reported")).otherwise(0.0).alias("fdp"),
    )


def pooled(scores: DataFrame) -> DataFrame:
    """Micro precision and recall over all datasets, and the mean false discovery proportion."""
    return scores.agg(
        F.count(F.lit(1)).alias("datasets"), (F.sum("true_reports") / F.sum("reported")).alias("precision"),
        (F.sum("true_reports") / F.sum("planted")).alias("recall"), F.avg("fdp").alias("mean_fdp"),
    )


def recall_by_level(matched: DataFrame, truth: DataFrame) -> DataFrame:
    planted = truth.where("label = 'injected'").groupBy("level").agg(F.count(F.lit(1)).alias("planted"))
    hits = matched.where("is_true").groupBy("level").agg(F.count(F.lit(1)).alias("hit"))
    return planted.join(hits, "level", "left").select("level", "planted", F.coalesce("hit", F.lit(0)).alias("hit"), (F.coalesce("hit", F.lit(0)) / F.col("planted")).alias("recall"))


def schema_fingerprint(roles: DataFrame) -> DataFrame:
    """SHA-256 of the JSON of sorted column: role pairs; a schema has as many rows as columns."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("column_name").alias("key"), F.col("role").alias("value"))))
    return roles.agg(F.sha2(F.to_json(F.map_from_entries(pairs)), 256).alias("fingerprint"), F.count(F.lit(1)).alias("columns"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def lesson_search(lessons: DataFrame, query: list[float], own_run: Column | None = None, top: int = TOP_LESSONS, least: float = MIN_SIMILARITY) -> DataFrame:
    """The most similar remembered lessons: one scan with a bounded heap per task, no sort of the store."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = lessons.withColumn("similarity", F.round(cosine(F.col("embedding"), vector), 9))
    able = scored.where(F.col("similarity") >= least)
    if own_run is not None:
        able = able.where(~own_run)
    return able.orderBy(F.col("similarity").desc(), "record_id").limit(top).drop("embedding")


def upsert(store: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """The store with new records; a record that is there already stays as it is."""
    first = new.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key] or [key]))).where("rn = 1").drop("rn")
    return store.unionByName(first.join(store.select(key), key, "left_anti"))


def browse(store: DataFrame, page: int, size: int, key: str = "record_id") -> DataFrame:
    return store.orderBy(key).offset(page * size).limit(size)
