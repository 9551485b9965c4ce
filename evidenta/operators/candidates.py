"""Candidate claims: scans over column pairs, screens and priorities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.quantiles import exact_quantile
from evidenta.operators import association as A
from evidenta.operators.prepare import keep_levels, name_words, names_time_axis
from evidenta.plans.config import SCAN, Scan

CLAIM = "claim_type string, var_a string, var_b string, magnitude double, direction string, reference_group string, n long"

# Wording that no single table can support.
UNIVERSAL_WORDS = (
    "always", "never", "all", "every", "everyone", "none", "no one", "nobody", "guarantees", "guaranteed", "invariably",
    "without exception",
)
CAUSAL_WORDS = (
    "causes", "cause", "caused", "causing", "leads to", "lead to", "leading to", "makes", "make", "making", "results in",
    "resulting in", "due to", "because of", "the effect of",
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _sign(c: Column) -> Column:
    return F.when(c > 0, "positive").when(c < 0, "negative")


def scan_correlation(df: DataFrame, columns: list[str], scan: Scan = SCAN) -> DataFrame:
    """Numeric pairs with enough rows and an absolute rank correlation of at least ``scan.rho``."""
    found = A.rank_matrix(df, columns, scan.rows).where(F.abs("rho") >= scan.rho)
    return found.select(
        F.lit("correlation").alias("claim_type"), F.col("a").alias("var_a"), F.col("b").alias("var_b"), F.abs("rho").alias("magnitude"),
        _sign(F.col("rho")).alias("direction"), F.lit(None).cast("string").alias("reference_group"), "n",
    )


def scan_group_difference(df: DataFrame, groups: list[str], values: list[str], scan: Scan = SCAN) -> DataFrame:
    """Label and number pairs with an eta squared of at least ``scan.eta_squared`` over levels with enough rows.

    Of two levels the one with the higher median is the reference group, of equal medians the first by label.
    """
    out = []
    for g in groups:
        rows = keep_levels(df, g, scan.group_rows, scan.levels)
        for v in values:
            size = A.eta_squared(rows, g, v).where((F.col("eta_squared") >= scan.eta_squared) & (F.col("n") >= scan.rows)).withColumn("one", F.lit(0))
            medians = exact_quantile(A.group_values(rows, g, v), "v", 0.5, ["g"], "m").agg(F.min_by("g", F.struct(-F.col("m"), "g")).alias("top"), F.count(F.lit(1)).alias("levels")).withColumn("one", F.lit(0))
            two = F.col("levels") == 2
            out.append(size.join(F.broadcast(medians), "one").select(
                F.lit("group_difference").alias("claim_type"), F.lit(g).alias("var_a"), F.lit(v).alias("var_b"), F.col("eta_squared").alias("magnitude"),
                F.when(two, "positive").alias("direction"), F.when(two, F.col("top")).alias("reference_group"), "n",
            ))
    return _union(out)


def scan_trend(df: DataFrame, times: list[str], values: list[str], scan: Scan = SCAN) -> DataFrame:
    """Time and number pairs whose period means have an absolute tau-b of at least ``scan.tau``."""
    out = []
    for t in times:
        for v in values:
            means = df.where(F.col(t).isNotNull() & F.col(v).isNotNull()).groupBy(F.col(t).alias("t")).agg(F.round(F.avg(v), 9).alias("v"), F.count(F.lit(1)).alias("m"))
            n = means.agg(F.sum("m").alias("n")).withColumn("one", F.lit(0))
            tau = A.kendall_tau_b(means, "t", "v", "t").where(F.abs("tau_b") >= scan.tau).withColumn("one", F.lit(0))
            out.append(tau.join(F.broadcast(n), "one").select(
                F.lit("trend").alias("claim_type"), F.lit(t).alias("var_a"), F.lit(v).alias("var_b"), F.abs("tau_b").alias("magnitude"),
                _sign(F.col("tau_b")).alias("direction"), F.lit(None).cast("string").alias("reference_group"), "n",
            ))
    return _union(out)


def prioritise(claims: DataFrame, cap: int = SCAN.cap) -> DataFrame:
    """One place is reserved for the strongest claim of each type, in order of strength; the rest is filled by magnitude."""
    inside = F.row_number().over(Window.partitionBy("claim_type").orderBy(F.col("magnitude").desc(), "var_a", "var_b"))
    placed = claims.withColumn("reserved", (inside == 1).cast("int"))
    order = Window.orderBy(F.col("reserved").desc(), F.col("magnitude").desc(), "claim_type", "var_a", "var_b")
    return placed.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).drop("reserved")


def with_ids(claims: DataFrame) -> DataFrame:
    """A claim's id names its type and columns."""
    return claims.withColumn("claim_id", F.concat_ws(":", "claim_type", "var_a", "var_b"))


def batch(df: DataFrame, numeric: list[str], groups: list[str], times: list[str], scan: Scan = SCAN) -> DataFrame:
    parts = [scan_correlation(df, numeric, scan)]
    if groups:
        parts.append(scan_group_difference(df, groups, numeric, scan))
    if times:
        parts.append(scan_trend(df, times, numeric, scan))
    return with_ids(prioritise(_union(parts), scan.cap))


def screen_words(claims: DataFrame, text: str = "claim") -> DataFrame:
    """``screen``: universal or causal wording, null if the wording is testable."""
    found = lambda words: F.col(text).rlike("(?i)\\b(" + "|".join(re.escape(w) for w in words) + ")\\b")
    return claims.withColumn("screen", F.when(found(UNIVERSAL_WORDS), "universal").when(found(CAUSAL_WORDS), "causal"))


def redundant_pair(a: str, b: str) -> bool:
    """Two names of one axis, or an amount and a part of its name."""
    if names_time_axis(a) and names_time_axis(b):
        return True
    x, y = set(name_words(a)), set(name_words(b))
    return bool(x and y) and (x <= y or y <= x)


def without_redundant(claims: DataFrame, columns: list[str]) -> DataFrame:
    """Claims without redundant column pairs; the pairs of columns are few and checked on the driver."""
    bad = [f"{a}\x00{b}" for a in columns for b in columns if a != b and redundant_pair(a, b)]
    return claims.where(~F.concat_ws("\x00", "var_a", "var_b").isin(bad)) if bad else claims


