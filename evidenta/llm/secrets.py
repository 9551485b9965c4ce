"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for candidate spans: three base kinds (assignments, access keys, long hex runs) and bare
high-entropy tokens.  Candidate values are hashed and aggregated over the whole corpus by distinct repositories
(documents) and owners (sources).  Values that COPIED_OWNERS owners hold, or that stand in COPIED_REPOS repositories,
are widely copied examples; values of a single owner in fewer repositories that look live (mixed character classes,
enough entropy, no placeholder words) are credentials.  Live bare tokens are added to the base spans as kind ``live``;
base spans always stay.

Defined cases: a null text counts as empty and has no spans; rows that share an id are one repository, and equal rows
of one id get equal spans; a null owner is one owner and a null id one repository; a very long text is scanned in time
proportional to its length and number of spans; ties do not occur (counts alone decide); an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, candidate_filter, may_contain, steps, stored

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Bare candidates: long runs that hold a digit and a letter, with at least this many bits per character.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_BITS = 3.0
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|test|xxxx|1234567|abcdef", re.IGNORECASE)
#: A value with at least this many owners, or in at least this many repositories, is a widely copied example.
COPIED_OWNERS, COPIED_REPOS = 2, 10

SPAN_SCHEMA = (
    "doc_id long, owner string, row long, kinds array<string>, starts array<long>, ends array<long>, "
    "hashes array<string>, live_looking array<boolean>"
)


def bits_per_char(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def looks_live(value: str) -> bool:
    has_digit = any("0" <= c <= "9" for c in value)
    has_letter = any("a" <= c <= "z" or "A" <= c <= "Z" for c in value)
    return has_digit and has_letter and bits_per_char(value) >= MIN_BITS and not PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's rank, end, value) of the base kinds; patterns run whole, then failing matches are dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return found


def outside(found: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[bool]:
    """Whether each of the spans ``found`` (by start) touches none of the spans ``base``: one merge of two sorted lists."""
    ordered, at, reached = sorted(base), 0, -1
    out = []
    for start, end in found:
        while at < len(ordered) and ordered[at][0] < end:
            reached = max(reached, ordered[at][1])
            at += 1
        out.append(reached <= start)
    return out


def candidates(text: str) -> list[tuple[int, str, int, str, bool]]:
    """(start, kind, end, value, live-looking) of base spans and of bare tokens outside them, by start and kind."""
    base = base_spans(text)
    rows = [(s, k, e, v, looks_live(v)) for s, k, e, v in base]
    bare = [m for m in BARE.finditer(text) if looks_live(m[0])]
    alone = outside([m.span() for m in bare], [(s, e) for s, _, e, _ in base])
    rows += [(m.start(), 3, m.end(), m[0], True) for m, a in zip(bare, alone, strict=True) if a]
    rows.sort(key=lambda r: (r[0], r[1]))
    return [(s, (*BASE_KINDS, "bare")[k], e, v, live) for s, k, e, v, live in rows]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document with its candidate spans, in one pass without a shuffle."""
    picked = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("scanned"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, 2):
            found = [candidates(t or "") for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), part.column(3),
                    pa.array([[r[1] for r in x] for x in found], pa.list_(pa.string())),
                    pa.array([[r[0] for r in x] for x in found], pa.list_(pa.int64())),
                    pa.array([[r[2] for r in x] for x in found], pa.list_(pa.int64())),
                    pa.array([[hashlib.sha256(r[3].encode()).hexdigest() for r in x] for x in found], pa.list_(pa.string())),
                    pa.array([[r[4] for r in x] for x in found], pa.list_(pa.bool_())),
                ],
                names=["doc_id", "owner", "row", "kinds", "starts", "ends", "hashes", "live_looking"],
            )

    return arrow_map(picked, run, SPAN_SCHEMA, "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """One row per candidate value: distinct repositories and owners over the corpus.

    Aggregated in three map-side combined steps (value, owner, repository), (value, owner), (value), so that a value
    that a third of all rows copy never meets in one task.
    """
    flat = scanned.select("doc_id", "owner", F.explode(F.array_distinct("hashes")).alias("hash"))
    per_owner = flat.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per row of ``df`` with its spans, each marked base, live or neither.

    Columns: doc_id, owner, spans array<struct<kind, start, end, hash, owned>>; ``owned`` marks live-looking values of
    a single owner in few repositories.  Bare candidates that are not owned are left out.
    """
    scanned = stored(scan(df, id_col, text_col, owner_col), "secrets")
    single = (F.col("owners") < COPIED_OWNERS) & (F.col("repos") < COPIED_REPOS)
    owned = stored(ownership(scanned).where(single).select("hash", F.xxhash64("hash").alias("value")), "secret-owners")
    live = scanned.select("row", F.posexplode(F.arrays_zip("hashes", "live_looking")).alias("place", "x")).where("x.live_looking")
    hashed = live.select("row", "place", F.col("x.hashes").alias("hash"), F.xxhash64("x.hashes").alias("value"))
    # The filter keeps copied values, of which one may stand in a third of all rows, out of the shuffle.
    marked = may_contain(hashed, "value", candidate_filter(owned, "value")).join(owned.select("hash"), "hash")
    places = marked.select("row", "place").distinct().groupBy("row").agg(F.collect_list("place").alias("owned_at"))
    joined = scanned.join(places, "row", "left")
    every = F.when(F.size("kinds") > 0, F.sequence(F.lit(0), F.size("kinds") - 1)).otherwise(F.array().cast("array<int>"))
    owned_at = F.coalesce("owned_at", F.array().cast("array<int>"))
    flags = F.array_sort(
        F.concat(
            F.transform(owned_at, lambda i: F.struct(i.alias("i"), F.lit(True).alias("owned"))),
            F.transform(F.array_except(every, owned_at), lambda i: F.struct(i.alias("i"), F.lit(False).alias("owned"))),
        )
    )
    spans = F.transform(
        flags,
        lambda x: F.struct(
            F.get("kinds", x["i"]).alias("kind"), F.get("starts", x["i"]).alias("start"), F.get("ends", x["i"]).alias("end"),
            F.get("hashes", x["i"]).alias("hash"), x["owned"].alias("owned"),
        ),
    )
    return joined.select("doc_id", "owner", F.filter(spans, lambda x: (x["kind"] != "bare") | x["owned"]).alias("spans"))
