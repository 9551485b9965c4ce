"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.runtime import ship

#: The characters that separate words in every contract: space and U+0009..U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]"

#: Bytes of text that one vectorised step of a Python worker takes at a time; bounds its memory.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[str, list[str]] = {}
#: Folders of the stored tables, for ``dropped``.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only a session without executors of its own (local mode, as in tests) may leave it unset; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "evidenta-checkpoints")
    path = f"{root.rstrip('/')}/evidenta-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application has written; results read from them are gone with them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        for found in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(path + "*")) or []:
            found.getPath().getFileSystem(conf).delete(found.getPath(), True)


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage at a table in the shared folder, so that a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{label}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: whatever was made of them has been stored itself."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_places.pop(df))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def hash_unit(*parts: Column) -> Column:
    """A uniform draw in (0, 1) from 52 bits of an MD5 of the parts, the same in every SQL engine."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(2**52))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def step_bounds(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(begin, rows) of runs of about ``size`` bytes of text (one very long text is a run alone)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    begin, base = 0, 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield begin, end - begin
        begin, base = end, int(ends[end - 1])


def array_steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[pa.Array]:
    for begin, rows in step_bounds(texts, size):
        yield texts.slice(begin, rows)


def steps(batches: Iterable[pa.RecordBatch], text_index: int, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches that hold about ``size`` bytes of text each."""
    for batch in batches:
        for begin, rows in step_bounds(batch.column(text_index), size):
            yield batch.slice(begin, rows)


def joined(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def flat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts as codes: (code of each word, words per text, dictionary of the codes)."""
    flat: list[bytes] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        counts[i] = len(words)
        flat += words
    coded = pa.array(flat, type=pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), counts, coded.dictionary


#: Bits of a candidate filter: at least LEAST_BITS, then FILTER_SPARE bits per key (about 6 % of other hashes pass).
#: A filter of more than BROADCAST_BITS (32 MB) is not broadcast; its keys are joined instead.
LEAST_BITS, FILTER_SPARE, BROADCAST_BITS = 22, 16, 28


@dataclass(frozen=True)
class KeyFilter:
    """Tells the rows whose hash is among ``keys``: by a bitmap of the hashes' low bits, which lets through every key
    and few others, or (with too many keys to broadcast one) by the keys themselves."""

    keys: DataFrame
    bits: int
    bitmap: DataFrame | None


def candidate_filter(keys: DataFrame, hash_col: str) -> KeyFilter:
    """A filter of the hashes in ``keys``, sized by their number; ``keys`` is read twice, so it should be stored."""
    bits = max(LEAST_BITS, (FILTER_SPARE * keys.count()).bit_length())
    known = keys.select(F.col(hash_col).alias("filter_key"))
    if bits > BROADCAST_BITS:
        return KeyFilter(known.distinct(), bits, None)
    slot = F.pmod(F.col("filter_key"), F.lit(1 << bits)) + 1
    bitmap = known.groupBy(F.bitmap_bucket_number(slot).alias("filter_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("filter_bits")
    )
    return KeyFilter(known, bits, bitmap)


def marked(df: DataFrame, hash_col: str, keys: KeyFilter, mark: str) -> DataFrame:
    """``df`` with a boolean column ``mark``: false only for rows whose hash is certainly not among the keys."""
    if keys.bitmap is None:
        known = keys.keys.withColumn("filter_hit", F.lit(True))
        return (
            df.join(known, F.col(hash_col) == F.col("filter_key"), "left")
            .withColumn(mark, F.coalesce("filter_hit", F.lit(False)))
            .drop("filter_key", "filter_hit")
        )
    slot = F.pmod(F.col(hash_col), F.lit(1 << keys.bits))
    probed = df.withColumn("filter_slot", slot).join(
        F.broadcast(keys.bitmap), F.shiftright("filter_slot", 15) + 1 == F.col("filter_bucket"), "left"
    )
    at = F.col("filter_slot").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("filter_bits", F.shiftright(at, 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return probed.withColumn(mark, F.coalesce(hit, F.lit(False))).drop("filter_slot", "filter_bucket", "filter_bits")


def may_contain(df: DataFrame, hash_col: str, keys: KeyFilter) -> DataFrame:
    """The rows of ``df`` whose hash the filter lets through; without a shuffle where the filter is a bitmap."""
    return marked(df, hash_col, keys, "filter_mark").where("filter_mark").drop("filter_mark")


#: At most so many keys are heavy: each of them has more than a HEAVY_KEYS-th of all counted rows.
HEAVY_KEYS = 1000


def heavy_rows(rows: int) -> int:
    return max(1000, rows // HEAVY_KEYS)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, rows: int) -> DataFrame:
    """``left`` left-joined to ``right`` (one row per key, with the key's number of rows), whatever the skew.

    The at most HEAVY_KEYS keys that hold more than a HEAVY_KEYS-th of ``rows`` are broadcast; a task of the shuffled
    join then meets no key with more rows than that.  ``left`` is read twice, so it should be stored.
    """
    least = heavy_rows(rows)
    heavy = right.where(F.col(count_col) > least)
    others = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right.where(F.col(count_col) <= least), keys, "left")
    return left.join(F.broadcast(heavy), keys).unionByName(others)


def bucket_count(rows: int, per_bucket: int, least: int = 64, most: int = 1 << 20) -> int:
    """Buckets so that each holds about ``per_bucket`` of ``rows``."""
    return max(least, min(most, rows // per_bucket))


#: Arrow batches between the JVM and Python: texts are long, so batches are bounded by bytes rather than by 10,000 rows.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "67108864b", "4194304"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "10000", "2000"),
}


def prepare(spark: SparkSession) -> None:
    """The package on the executors' Python path, and batches small enough for long texts unless the session says otherwise."""
    ship(spark)
    for key, (*defaults, ours) in BATCH_CONF.items():
        if spark.conf.get(key, None) in defaults:
            spark.conf.set(key, ours)


#: What operators keep in a Python worker between tasks: name and how to drop it.
HOLDERS: dict[str, Callable[[], None]] = {}
_current = [""]


def enter(operator: str) -> None:
    """Called by a task of an operator: what other operators left in this worker is dropped.

    Spark reuses workers, so without this the caches of all operators that ever ran there would add up.
    """
    if _current[0] != operator:
        for name, drop in HOLDERS.items():
            if name != operator:
                drop()
        give_back()
        _current[0] = operator


def arrow_map(df: DataFrame, run, schema, operator: str = "") -> DataFrame:
    """``df.mapInArrow`` for texts; a worker gives its memory back after a task."""
    prepare(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(operator)
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory to the system: an idle worker should not hold what its last task needed."""
    gc.collect()
    trim()


def trim() -> None:
    """``give_back`` without looking for cycles: a few milliseconds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU allocator
        pass
