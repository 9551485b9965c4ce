"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing to target weights, BPE round trip.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage cuts it.

Defined cases of every stage: an empty table gives an empty one; columns are kept whatever their names (an ``n_chars``
is only counted anew where there is one); very long texts are worked whole.  Nulls, empty texts, repeated rows and
rows that share an id are as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.llm import bpe, linededup, minhash, mixing, quality
from evidenta.llm.common import WORD_RE, stored, table
from evidenta.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or another rule on a bad host, go.

    Null and empty texts have no words and go; every row is judged alone, so repeated rows and shared ids do not matter.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which no word is left go.

    Null and empty texts go; rows that share an id lose only what an earlier text holds; equal rows of one id are one
    document and lose the same; rows with a null id are not cut.
    """
    return _counted(linededup.clean(docs)).where(F.col("text").rlike(WORD_RE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays, once.

    Rows go for their own text alone: a row that shares its id with a near-duplicate stays.  Equal rows are near-duplicates
    of each other.  Rows without words or with a null id stay.
    """
    return minhash.keep_one(docs, minhash.Settings(words=5, over=80, under=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one of a source's budget is cut at the exact word.

    Null and empty texts go along with whole epochs; a null source is a source; repeated rows are mixed row by row.
    """
    return _counted(mixing.mixed_rows(docs))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's token ids and of their decoded text, row by row; a null text counts as empty."""
    return bpe.round_trip_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]

#: BPE merges cannot be written in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
