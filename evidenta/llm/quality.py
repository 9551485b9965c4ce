"""Quality rules with host-level verdicts.

Each document is measured against line, symbol and repetition rules.  Failures are then aggregated by host, the
host's failure rate is shrunk towards all hosts with an empirical beta prior (method of moments), and the host's
verdict is joined back.  A host verdict only removes documents that fail a rule themselves, so clean documents of a
bad host stay.

The prior's variance is what the hosts' rates vary beyond the noise of their binomial counts; small hosts are
therefore drawn far towards the mean, large ones hardly.

Defined cases: a null or empty text has no words and fails; repeated rows, and rows that share an id, are measured
row by row; a null host forms one host; a rate at the limit is not above it (ties keep); a very long text is measured
whole, in time proportional to its words; an empty table gives an empty result; extra columns are ignored by
``judge`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array_steps, enter, flat_words, mix64, prepare, stored, text_bytes, trim

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document breaks the symbol rule above this many symbols per 100 words, the line rule above this share of lines.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host is bad when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Documents that the prior counts for at most (hosts whose rates vary by no more than chance get the mean rate).
MOST_STRENGTH = 1_000_000.0

#: Up to so many bad hosts are sent to all tasks (a few MB); more of them are joined by a shuffle.
BROADCAST_HOSTS = 20_000

SYMBOLS = b"#*$%&|<>"
NOT_WORD_START = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that stand in a window of words which the text holds at least twice."""
    n, texts = len(codes), len(counts)
    if n < window:
        return np.zeros(texts, dtype=np.int64)
    owner = np.repeat(np.arange(texts), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    word = mix64(codes.astype(np.uint64) + np.uint64(1))
    rolling = np.zeros(n - window + 1, dtype=np.uint64)
    for j in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + word[j : n - window + 1 + j]
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= ends[: n - window + 1])
    keys = mix64(rolling[starts]) ^ mix64(owner[starts].astype(np.uint64) + np.uint64(0x51ED27))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hits = starts[order[twice]]
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(owner[covered], minlength=texts).astype(np.int64)


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    codes, counts, _ = flat_words(texts)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": counts,
        "word_chars": np.array([len(t.translate(None, NOT_WORD_START)) for t in texts], dtype=np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_lines": np.array([len(x) for x in lines], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": repeated_words(codes, counts),
    }


MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@F.arrow_udf(MEASURED)
def measures_of(text: pa.Array) -> pa.Array:
    """The MEASURES of each text.  Only texts go to Python and only numbers come back."""
    enter("quality")
    parts = []
    for part in array_steps(text):
        found = measure_texts(text_bytes(part))
        parts.append(pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], names=list(MEASURES)))
    trim()  # a scalar function does not see its task's end
    return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.int64())] * len(MEASURES), names=list(MEASURES))


#: Declared non-deterministic so that a filter on its result does not evaluate it a second time below.
measures_of = measures_of.asNondeterministic()


def measure(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The carried columns and the MEASURES of each row's whole text, in one pass without a shuffle."""
    prepare(df.sparkSession)
    return df.select(*carry, measures_of(F.col(text_col)).alias("measured")).select(*carry, "measured.*")


def rules(measured: DataFrame) -> DataFrame:
    """Add base_failed (the two hard rules) and any_failed (hard, symbol or line rule)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (
        100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    )
    return measured.withColumn("base_failed", base).withColumn("any_failed", base | soft)


def host_verdicts(ruled: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and verdict.

    The prior's two parameters come from the mean and variance of the hosts' rates.  They are three numbers, read by
    the driver from one aggregated row.  With fewer than two hosts one pseudo-document at the mean rate is the prior.
    """
    hosts = ruled.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("any_failed").cast("long")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_docs")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inverse")).first()
    alpha, beta = beta_prior(row["m"], row["v"], row["inverse"])
    shrunk = (F.col("host_failures") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > F.lit(limit))


def beta_prior(mean: float | None, variance: float | None, inverse_docs: float | None = 0.0) -> tuple[float, float]:
    """(alpha, beta) from the mean and variance of the hosts' rates and the mean of 1 / documents of a host.

    A host's rate varies by m (1 - m) / n around its own mean by chance alone; that much is taken off the variance.
    """
    mean = mean or 0.0
    if variance is None or mean <= 0.0 or mean >= 1.0:
        return mean, 1.0 - mean
    spread = mean * (1.0 - mean)
    between = variance - spread * (inverse_docs or 0.0)
    strength = min(max(spread / between - 1.0, 1.0), MOST_STRENGTH) if between > 0.0 else MOST_STRENGTH
    return mean * strength, (1.0 - mean) * strength


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, base verdict, host rate and final verdict of every row of ``df``."""
    ruled = rules(stored(measure(df, text_col, (id_col, host_col)), "quality"))
    hosts = host_verdicts(ruled, host_col)
    out = ruled.join(hosts, F.col(host_col).eqNullSafe(F.col("host")), "left")
    return out.select(
        id_col, host_col, *MEASURES, "base_failed", "any_failed", "host_docs", "host_failures", "host_rate", "host_bad",
        (~F.col("base_failed") & ~(F.col("host_bad") & F.col("any_failed"))).alias("kept"),
    )


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with all their columns.

    The verdict of a row is a function of its measures and its host, so the texts are not shuffled: the rows are
    measured in a first pass for the hosts, and again where they stand in the second.
    """
    narrow = df.select(F.col(host_col).alias("host_key"), F.col(text_col).alias("measured_text"))
    ruled = rules(stored(measure(narrow, "measured_text", ("host_key",)), "quality"))
    bad = stored(host_verdicts(ruled, "host_key").where("host_bad").select("host", "host_bad"), "bad-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), measures_of(F.col(text_col)).alias("measured"))
    again = rules(packed.select("row", "measured.*"))
    kept = again.join(bad, F.col(f"row.{host_col}").eqNullSafe(F.col("host")), "left").where(
        ~F.col("base_failed") & ~(F.coalesce("host_bad", F.lit(False)) & F.col("any_failed"))
    )
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
