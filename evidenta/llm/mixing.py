"""Mixing sources to target weights.

Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...  They share all words by weight; a target stops
at MAX_EPOCHS times its source's words and the excess is shared again by weight until none is above.  The closed form
of that is a water level: with sources sorted by cap / weight, the level is the greatest of (words left after the
caps before) / (weights from here on).

Within a source rows are ordered by a hash-random key.  The key's leading bits are range buckets, so prefix sums of
word counts are bucket totals plus running sums inside a bucket, and no task ever holds a source.  A source is taken
whole as many times as its budget allows (epochs); the rest is cut at the exact word.

Of the mix itself only the bucket that holds a source's cut needs an order: the rows of all other buckets are repeated
where they stand, and their texts are not shuffled.

Defined cases: a null or empty text has no words (its row goes along with every whole epoch of its source); a source
without words has target 0; a null source is a source of its own; ties of the key fall back to the id, the size and
the text's hash; repeated rows, and rows that share an id, are rows of their own; a very long text is one row, cut at
the exact word where the budget ends inside it; an empty table gives an empty result; extra columns are ignored by
``mix`` and kept by ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, stored, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
ROWS_PER_BUCKET = 256
#: Bits of the key that number the range buckets; beyond 2**20 buckets a source, buckets hold more rows instead.
LEAST_BITS, MOST_BITS = 8, 20
#: Up to so many sources' verdicts are sent to all tasks (a few MB); more of them are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, budget) from rows of (source, size); windows run over one row per source."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = ranked.withColumn("level", (total - before) / onward)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))
    return level.withColumn("target", target).select(
        "source", "source_size", "target", F.floor(F.col("target") + F.lit(0.5)).cast("long").alias("budget")
    )


def random_key(id_col: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_col.cast("string"), F.lit(""))))


def bucket_of(key: Column, bits: int) -> Column:
    """The range of the key space that a key falls in: its leading bits."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def cut_places(narrow: DataFrame) -> DataFrame:
    """(s, b, bucket_before, bucket_size, source_size, target, epochs, rest) of every bucket of every source.

    ``epochs``: how often the source is taken whole; ``rest``: words of its last, partial epoch.
    """
    targets = source_targets(narrow)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    return (
        narrow.groupBy("source", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("bucket_before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
        .join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_before", "bucket_size", "source_size", "target", "budget", epochs.alias("epochs"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .drop("budget")
    )


def with_partial(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (source, bucket, key, row_id, size, tie) of whole buckets with their places and ``partial``: words of the last epoch."""
    inside = Window.partitionBy("source", "bucket").orderBy("key", "row_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("bucket_before") + F.col("running")
    return (
        rows.withColumn("running", F.sum("size").over(inside) - F.col("size"))
        .join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("partial", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before)))
    )


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, bits: int, *more: Column) -> DataFrame:
    out = df.select(
        F.col(id_col).alias("row_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        random_key(F.col(id_col)).alias("key"), F.xxhash64(F.col(text_col)).alias("tie"), *more,
    )
    return out.withColumn("bucket", bucket_of(F.col("key"), bits))


def key_bits(rows: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (rows // ROWS_PER_BUCKET).bit_length()))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; only narrow rows are shuffled."""
    bits = key_bits(df.count())
    narrow = stored(_keyed(df, id_col, text_col, source_col, bits), "mixing")
    placed = with_partial(narrow, cut_places(narrow))
    return placed.select(
        F.col("row_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken"),
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``df`` as often as its epochs say, and cut after its partial words where the budget ends.

    All columns are kept; a row that is taken several times stands there several times.
    """
    bits = key_bits(df.count())
    narrow = stored(_keyed(df, id_col, text_col, source_col, bits), "mixing")
    places = stored(cut_places(narrow), "mix-places")
    holds_cut = (F.col("bucket_before") < F.col("rest")) & (F.col("rest") < F.col("bucket_before") + F.col("bucket_size"))
    taken_whole = F.col("bucket_before") + F.col("bucket_size") <= F.col("rest")
    # Buckets before the cut are taken once more: the cut of a source is its last such bucket, then the one that holds it.
    verdicts = stored(
        places.groupBy("s", "epochs").agg(
            F.coalesce(F.max(F.when(taken_whole & (F.col("rest") > 0), F.col("b"))), F.lit(-1)).alias("whole_upto"),
            F.max(F.when(holds_cut, F.col("b"))).alias("cut_bucket"),
        ),
        "mix-verdicts",
    )
    if verdicts.count() <= BROADCAST_SOURCES:
        verdicts = F.broadcast(verdicts)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    dealt = whole.select(
        "row", F.col("row")[source_col].alias("source"), bucket_of(random_key(F.col("row")[id_col]), bits).alias("bucket")
    ).join(verdicts, F.col("source").eqNullSafe(F.col("s")))
    in_cut = F.coalesce(F.col("bucket") == F.col("cut_bucket"), F.lit(False))
    once_more = (F.col("bucket") <= F.col("whole_upto")) & F.coalesce(F.col("row")[text_col].rlike(WORD_RE), F.lit(False))
    uncut = dealt.where(~in_cut).select("row", (F.col("epochs") + once_more.cast("long")).cast("int").alias("full"), F.lit(0).cast("long").alias("words"))
    ordered = dealt.where(in_cut).select(
        "row", "source", "bucket", F.col("row")[id_col].alias("row_id"), random_key(F.col("row")[id_col]).alias("key"),
        word_count(F.col("row")[text_col]).alias("size"), F.xxhash64(F.col("row")[text_col]).alias("tie"),
    )
    placed = with_partial(ordered, places)
    all_of_it = (F.col("partial") == F.col("size")) & (F.col("size") > 0)
    cut_rows = placed.select(
        "row", (F.col("epochs") + all_of_it.cast("long")).cast("int").alias("full"),
        F.when((F.col("partial") > 0) & ~all_of_it, F.col("partial")).otherwise(F.lit(0)).cast("long").alias("words"),
    )
    copies = F.concat(F.array_repeat(F.lit(False), F.col("full")), F.array_repeat(F.lit(True), F.when(F.col("words") > 0, 1).otherwise(0)))
    out = uncut.unionByName(cut_rows).withColumn("is_cut", F.explode(copies))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    return out.select(
        *[F.when(F.col("is_cut"), cut).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    )
