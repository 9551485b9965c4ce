"""Exact deduplication over an extendible-hash index on shared files.

Texts are compared without white space.  The index holds one narrow entry per document (64-bit key, SHA-256, length)
as files in the shared folder.  Entries whose key occurs again are dealt to buckets by the leading bits of their keys:
the directory starts with as many bits as the number of entries asks for and doubles, bucket by bucket, where a bucket
holds more entries than a page takes.  A bucket that no doubling makes smaller (one key that very many rows share)
gets a chain of pages.  The directory decides which task compares which texts: a task owns (bucket, page) pairs, meets
all texts of their key ranges, chains the different texts of one key and compares them by their bytes.  Pages of one
chain are then merged, again by bytes, so that no task ever meets all rows of a key.

The directory has one row per slot, and the page size grows with the entries so that there are at most 2**SLOT_BITS
slots; that is what makes it safe to broadcast.

Defined cases: a null text counts as empty, and empty texts are equal to each other; of equal texts the longest
original and then the smallest id stays; rows with a null id never stay for another row; repeated rows, and rows that
share an id, are members of their texts' groups like any other row; a very long text is one value of its task and is
never cut; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import candidate_filter, join_counted, may_contain, stored

#: Entries of a bucket page, and how often a bucket may double beyond the directory's first depth.
PAGE_ENTRIES = 4096
DOUBLINGS = 6
SLOT_BITS = 20

_FULL = Decimal(2**64)


def normalised(text: Column) -> Column:
    """The text without the six characters of white space."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def first_depth(entries: int, page: int) -> int:
    """Bits that the directory starts with: an eighth to a quarter of the buckets that the entries fill."""
    return max(0, (entries // page).bit_length() - DOUBLINGS // 2)


def page_size(entries: int, least: int = PAGE_ENTRIES) -> int:
    return max(least, entries >> (SLOT_BITS - DOUBLINGS))


def slot(key: Column, bits: int) -> Column:
    """Directory slot of a key: its leading bits."""
    return F.shiftrightunsigned(key, 64 - bits)


def directory(entries: DataFrame, page: int, start: int) -> DataFrame:
    """(slot, depth, bucket, load, pages) of the extendible-hash directory of rows with a column ``key``.

    A slot's bucket has the least depth at which the entries that share so many leading bits fit a page; ``bucket`` is
    the first slot of its key range.  A bucket that is overfull at the last depth has a chain of ``pages``.
    """
    bits = start + DOUBLINGS
    counts = entries.groupBy(slot(F.col("key"), bits).alias("slot")).agg(F.count(F.lit(1)).alias("entries"))
    found = counts.withColumn("home", F.shiftright("slot", DOUBLINGS)).repartition("home")
    depth, load = F.lit(bits), F.col("entries")
    for d in range(bits - 1, start - 1, -1):
        together = F.sum("entries").over(Window.partitionBy("home", F.shiftright("slot", bits - d)))
        found = found.withColumn(f"load{d}", together)
        depth, load = F.when(F.col(f"load{d}") <= page, d).otherwise(depth), F.when(F.col(f"load{d}") <= page, F.col(f"load{d}")).otherwise(load)
    doubled = found.select("slot", depth.alias("depth"), load.alias("load"))
    inside = F.lit(bits) - F.col("depth")
    first = F.call_function("shiftleft", F.call_function("shiftright", F.col("slot"), inside), inside)
    return doubled.select("slot", "depth", first.alias("bucket"), "load", F.ceil(F.col("load") / F.lit(page)).cast("long").alias("pages"))


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow entries of all rows, on shared files."""
    norm = normalised(F.col(text_col))
    return stored(
        df.select(
            F.col(id_col).cast("long").alias("id"), key_of(norm).alias("key"),
            F.sha2(norm.cast("binary"), 256).alias("sha"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("length"),
        ),
        "exact-index",
    )


def rank(length: Column, id_col: Column) -> Column:
    """One number that is greatest for the longest text and then the smallest id; it fits a hash aggregate's buffer."""
    longest = length.cast("decimal(20,0)") * F.lit(_FULL)
    return (longest + (F.lit(Decimal(2**63 - 1)) - id_col.cast("decimal(20,0)"))).cast("decimal(38,0)")


def rank_id(ranked: Column) -> Column:
    return (F.lit(Decimal(2**63 - 1)) - (ranked % F.lit(_FULL))).cast("long")


def owned_pages(texts: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """(key, norm, sha, pages, n, best) of the texts, compared by the owner of their bucket and page; stored.

    ``norm`` is kept only where a chain of pages has to be merged.
    """
    dealt = F.pmod(F.xxhash64("id", "length", F.spark_partition_id()), F.col("pages"))
    routed = texts.withColumn("slot", slot(F.col("key"), bits)).join(F.broadcast(slots), "slot").withColumn("page", dealt)
    compared = (
        routed.select("bucket", "page", "pages", "key", "norm", "id", "length")
        .repartition("bucket", "page")
        .groupBy("bucket", "page", "pages", "key", "norm")
        .agg(F.count(F.lit(1)).alias("n"), F.max(rank(F.col("length"), F.col("id"))).alias("best"))
    )
    text = F.when(F.col("pages") > 1, F.col("norm")).alias("norm")
    return stored(compared.select("key", text, F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "pages", "n", "best"), "exact-pages")


def chains(pages: DataFrame) -> DataFrame:
    """(key, sha, group_size, keep_id) of every text that occurs again."""
    alone = pages.where("pages = 1").select("key", "sha", "n", "best")
    merged = (
        pages.where("pages > 1")
        .groupBy("key", "norm")
        .agg(F.first("sha").alias("sha"), F.sum("n").alias("n"), F.max("best").alias("best"))
        .select("key", "sha", "n", "best")
    )
    again = alone.unionByName(merged).where("n > 1")
    return again.select("key", "sha", F.col("n").alias("group_size"), rank_id(F.col("best")).alias("keep_id"))


def equal_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_entries: int = PAGE_ENTRIES) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) of every row of ``df``."""
    entries = index(df, id_col, text_col)
    shared = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1"), "exact-keys")
    keys = candidate_filter(shared, "key")
    mates = may_contain(entries.select("key"), "key", keys)
    total = mates.count()
    page = page_size(total, page_entries)
    start = first_depth(total, page)
    slots = stored(directory(mates, page, start), "exact-directory")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("original"))
    texts = texts.select("id", normalised(F.col("original")).alias("norm"), F.length(F.coalesce("original", F.lit(""))).alias("length"))
    compared = may_contain(texts.withColumn("key", key_of(F.col("norm"))), "key", keys)
    groups = stored(chains(owned_pages(compared, slots, start + DOUBLINGS)), "exact-groups")
    out = join_counted(entries, groups, ["key", "sha"], "group_size", entries.count())
    return out.select(
        "id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.coalesce("keep_id", "id") == F.col("id"), F.coalesce("keep_id", "id").isNull()).alias("kept"), "sha",
    )
