"""The exact report: every registered analysis of a table, each on its own, told in order of weight.

An analysis is a function of a context that returns figures (subject, label, value).  It names what it needs of the
context; without that, or when it fails, its place is taken by a ``not_run`` figure with the reason, and the others go
on.  ``register`` adds analyses.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.scalars import shown
from evidenta.operators import exact as E
from evidenta.operators import prepare as P
from evidenta.operators.gateway import story
from evidenta.operators.windows import WindowPair, window_pair
from evidenta.plans.config import EXACT, STORY_WEIGHTS

log = logging.getLogger(__name__)

FIGURES = "kind string, subject string, label string, value double, status string, note string"
#: Figures of one analysis that a report takes; an analysis is a summary, so more of them is a failure, not a cut.
MOST_FIGURES = 5_000


@dataclass(frozen=True)
class Context:
    """What analyses may ask for; None or an empty list is something that the table does not have."""

    df: DataFrame
    measures: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    ordinal: str | None = None
    revenue: str | None = None
    cost: str | None = None
    units: str | None = None
    customer: str | None = None
    weight: str | None = None
    cases: str | None = None
    population: str | None = None
    pair: WindowPair | None = None


Analysis = Callable[[Context], DataFrame]
ANALYSES: dict[str, tuple[Analysis, tuple[str, ...]]] = {}


def register(name: str, *needs: str) -> Callable[[Analysis], Analysis]:
    """Add an analysis under a name, with the parts of the context that it needs."""

    def add(run: Analysis) -> Analysis:
        ANALYSES[name] = (run, needs)
        return run

    return add


def figures(df: DataFrame, subject: Column | str, label: Column | str, value: str) -> DataFrame:
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(as_column(subject).alias("subject"), as_column(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpivoted(df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.lit(subject).alias("subject"), F.explode(cells).alias("x")).select("subject", "x.*")


@register("period_change", "measures", "ordinal", "pair")
def _period_change(c: Context) -> DataFrame:
    return figures(E.period_change(c.df, c.measures, c.pair, c.ordinal), F.col("measure"), "change", "change")


@register("margins", "revenue", "cost", "ordinal", "pair")
def _margins(c: Context) -> DataFrame:
    return figures(E.margins(c.df, c.revenue, c.cost, c.segments[:4], c.pair, c.ordinal), F.col("column_name"), F.col("level"), "change")


@register("variance_decomposition", "measures", "segments", "ordinal", "pair")
def _variance(c: Context) -> DataFrame:
    return _together([figures(E.variance_decomposition(c.df, s, c.measures[0], c.pair, c.ordinal), s, F.col("segment"), "change") for s in c.segments])


@register("concentration", "measures", "customer")
def _concentration(c: Context) -> DataFrame:
    return unpivoted(E.concentration(c.df, c.customer, c.measures[0]), c.customer, ["largest_share", "top_tenth_share"])


@register("pareto", "measures", "segments")
def _pareto(c: Context) -> DataFrame:
    return _together([figures(E.pareto(c.df, s, c.measures[0]), s, F.col("segment"), "cumulative_share") for s in c.segments])


@register("segment_ranking", "measures", "segments")
def _ranking(c: Context) -> DataFrame:
    return _together([figures(E.segment_ranking(c.df, s, c.measures[0]), s, F.col("segment"), "total") for s in c.segments])


@register("outliers", "measures", "ordinal")
def _outliers(c: Context) -> DataFrame:
    return figures(E.period_outliers(c.df, c.ordinal, c.measures[0]), c.measures[0], F.col(c.ordinal), "z")


@register("seasonality", "measures", "ordinal")
def _seasonality(c: Context) -> DataFrame:
    return figures(E.seasonality(c.df, c.measures[0], c.ordinal), c.measures[0], F.col("position"), "index")


@register("price_volume_mix", "revenue", "units", "segments", "ordinal", "pair")
def _pvm(c: Context) -> DataFrame:
    parts = ["volume", "mix", "price", "other"]
    return _together([unpivoted(E.price_volume_mix(c.df, s, c.revenue, c.units, c.pair, c.ordinal), s, parts) for s in c.segments])


@register("segment_growth", "measures", "segments", "ordinal", "pair")
def _growth(c: Context) -> DataFrame:
    return _together([figures(E.segment_growth(c.df, s, c.measures[0], c.pair, c.ordinal), s, F.col("segment"), "growth") for s in c.segments])


@register("customer_view", "measures", "customer", "ordinal")
def _customers(c: Context) -> DataFrame:
    return unpivoted(E.customer_view(c.df, c.customer, c.measures[0], c.ordinal), c.customer, ["top_ten_share", "top_tenth_share", "repeat_share"])


@register("rfm", "measures", "customer", "ordinal")
def _rfm(c: Context) -> DataFrame:
    return figures(E.rfm_segments(E.rfm(c.df, c.customer, c.measures[0], c.ordinal)), c.customer, F.col("rfm_segment"), "money_share")


@register("weighted_means", "measures", "weight")
def _means(c: Context) -> DataFrame:
    return figures(E.weighted_means(c.df, c.measures, c.weight), F.col("measure"), "weighted mean", "mean")


@register("rates", "cases", "population", "segments")
def _rates(c: Context) -> DataFrame:
    return _together([figures(E.rates(c.df, c.cases, c.population, s), s, F.col("segment"), "rate") for s in c.segments])


def context_of(df: DataFrame, ordinal: str | None = None, **known: str) -> Context:
    """A context from the columns' roles: numbers as measures, few labels as segments; ``known`` names the rest."""
    roles = {r["column_name"]: r for r in P.column_roles(df).collect()}  # one row per column
    taken = {ordinal, *known.values()}
    measures = [c for c in df.columns if c not in taken and roles[c]["role"] == "numeric"]
    segments = [c for c in df.columns if c not in taken and roles[c]["role"] == "categorical" and roles[c]["distinct"] <= EXACT.segments]
    first = [known[k] for k in ("revenue", "cost", "units") if k in known]
    return Context(df, (first + measures)[: EXACT.measures], segments, ordinal, pair=window_pair(df, ordinal) if ordinal else None, **known)


def exact_report(c: Context, names: list[str] | None = None) -> DataFrame:
    """FIGURES of the named analyses (all registered ones without); one ``not_run`` row for each that cannot run.

    Figures are summaries of a bounded number, so each analysis is run to its end before the next one, and the report
    does not fail with one of them.
    """
    rows = []
    for name in names if names is not None else list(ANALYSES):
        if name not in ANALYSES:
            rows.append((name, "(none)", "(none)", None, "not_run", "no such analysis"))
            continue
        run, needs = ANALYSES[name]
        lacking = [n for n in needs if not getattr(c, n)]
        if lacking:
            rows.append((name, "(none)", "(none)", None, "not_run", "the table has no " + ", ".join(lacking)))
            continue
        try:
            found = run(c).limit(MOST_FIGURES + 1).collect()
            if len(found) > MOST_FIGURES:
                raise ValueError(f"more than {MOST_FIGURES} figures")
        except Exception:  # one analysis must not end the report
            log.exception("analysis %s failed", name)
            rows.append((name, "(none)", "(none)", None, "not_run", "the analysis failed"))
            continue
        rows += [(name, r["subject"], r["label"], r["value"], "ok", None) for r in found]
        if not found:
            rows.append((name, "(none)", "(none)", None, "not_run", "nothing to report"))
    return c.df.sparkSession.createDataFrame(rows, FIGURES)


def told(report: DataFrame, weights: dict[str, int] | None = None, leads: int = 8) -> DataFrame:
    """(item_id, kind, subject, weight, lead, position) of the report's items, by weight; kinds without one come last."""
    items = report.where("status = 'ok'").select("kind", "subject").distinct()
    items = items.withColumn("item_id", F.concat_ws(":", "kind", "subject")).withColumn("bonus", F.lit(0))
    return story(items, STORY_WEIGHTS if weights is None else weights, leads).select("item_id", "kind", "subject", "weight", "lead", "position")


def summary_lines(report: DataFrame, most: int = 6, weights: dict[str, int] | None = None) -> DataFrame:
    """(position, text) of the first items: each by its figure of greatest size."""
    by = Window.partitionBy("kind", "subject").orderBy(F.abs("value").desc_nulls_last(), "label")
    top = report.where("status = 'ok'").withColumn("rn", F.row_number().over(by)).where("rn = 1").select("kind", "subject", "label", "value")
    named = F.regexp_replace("kind", "_", " ")
    text = F.concat_ws(" ", F.concat(named, F.lit(" of "), F.col("subject"), F.lit(":")), "label", F.coalesce(shown(F.col("value")), F.lit("n/a")))
    placed = told(report, weights, most).where(F.col("position") <= most)
    return placed.join(top, ["kind", "subject"]).select("position", text.alias("text"))
