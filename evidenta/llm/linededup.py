"""Line deduplication by content-defined chunks of lines.

A text is cut into *soft lines*: after each line feed, and inside a line after a mark of punctuation and a space or
after eight words, so that passages inside a long line are comparable too.  A rolling hash over the hashes of two neighbouring soft lines
chooses the chunk boundaries: a chunk ends where the rolling hash is a local minimum.  A boundary depends on four soft
lines alone, so an inserted or deleted line moves no other one, and every chunk holds at least two soft lines (three
on average).  Nothing else places a boundary.

Chunks are counted over the whole corpus by a 64-bit key; those that occur again are compared by their bytes, and
each chunk keeps its first occurrence (smallest id, then place).  Later occurrences are removed where consecutive
ones together hold MIN_WORDS words; shorter repeats (headings, greetings) stay.  What stays of a repeated passage is
its first occurrence, and of its copies at most the soft lines before the first and after the last boundary inside it.

Of the whole corpus only keys are shuffled.  Texts are cut once and stored with their keys, chunk by chunk; only
documents that lose something are cut again, and joined with their places.  A stored table goes as soon as what was
made of it is stored.

Defined cases: a null text stays null; an empty text has no line and loses nothing; rows are told apart by id and
text, so rows that share an id keep their own texts and equal rows of one id count as one document (none loses
what the other holds); rows with a null id lose nothing; ties fall to the smaller place; a very long text is cut in
time proportional to its length, in one task; a text of fewer than four soft lines is one chunk; an empty table gives
an empty result; all columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import candidate_filter, dropped, join_counted, marked, may_contain, stored, word_count

#: Soft lines as a pattern: up to seven words that end in a space and no punctuation, then a word with the space or
#: line feed behind it, or the text's last word.  The second form finds the same without possessive steps, for SQL.
SOFT_LINE = r"(?:[^ \n]*+ (?<![.,;:!?] )){0,7}(?:[^ \n]*+[ \n]|[^ \n]++)"
SOFT_LINE_SQL = r"(?:(?:[^ \n]*[^ \n.,;:!?])? ){0,7}(?:[^ \n]*[ \n]|[^ \n]+\z)"
MIN_WORDS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (the optimiser would copy a projected column into every use)."""
    return F.transform(F.array(value), body)[0]


def _ends(rolled: Column) -> Column:
    """Places of the lines that end a chunk: local minima with two lines on either side, and the last line."""
    last = F.size(rolled) - 1

    def is_least(i: Column) -> Column:
        here = F.get(rolled, i)
        return (here < F.get(rolled, i + 1)) & (here < F.get(rolled, i - 1))

    # Places 1 to last - 2: a sequence that would run backwards is one of a text with fewer than four lines.
    inner = F.when(last >= 3, F.filter(F.sequence(F.lit(1), last - 2), is_least)).otherwise(F.array().cast("array<int>"))
    return F.array_append(inner, last)


def _between(lines: Column, ends: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of the lines of every chunk, from the chunks' end places."""

    def made(end: Column, k: Column) -> Column:
        before = F.coalesce(F.get(ends, k - 1), F.lit(-1))
        return make(F.slice(lines, before + 2, end - before))

    return F.transform(ends, made)


def _rolled(lines: Column) -> Column:
    """The rolling hash: the MD5 of each line and the one before it, compared as hexadecimal text."""
    return F.transform(lines, lambda x, i: F.md5(F.concat(F.coalesce(F.get(lines, i - 1), F.lit("")), x)))


def chunked(text: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of the array of soft lines of every chunk of a text; null for a null or empty text."""
    lines = F.regexp_extract_all(text, F.lit(SOFT_LINE), F.lit(0))
    cut = let(lines, lambda x: let(_rolled(x), lambda rolled: let(_ends(rolled), lambda ends: _between(x, ends, make))))
    return F.when(F.length(text) > 0, cut)


def text_of(lines: Column) -> Column:
    return F.array_join(lines, "")


def chunks(text: Column) -> Column:
    """array<string> of the chunks of a text; put together they give the text again.  Null for a null or empty text."""
    return chunked(text, text_of)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, row, text): rows are told apart by ``tie`` and ``row``, hashes of the text and of id and text."""
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.where("id is not null and length(text) > 0").select("id", *row_key("id", "text"), "text")


def row_key(id_col: str, text_col: str) -> list[Column]:
    tie = F.shiftrightunsigned(F.xxhash64(text_col), 33).alias("tie")
    return [tie, F.xxhash64(id_col, text_col).alias("row")]


def place_rank(id_col: Column, tie: Column, place: Column) -> Column:
    """One number that orders occurrences by id, text and place; it fits a hash aggregate's buffer."""
    inside = tie.cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + place.cast("decimal(10,0)")
    return (id_col.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + inside).cast("decimal(38,0)")


def cut_rows(texts: DataFrame) -> DataFrame:
    """(id, tie, row, keys, chunks) of the rows of ``_rows``, stored, so that a text is cut once.

    The arrays are not exploded before they are stored, and outer when they are: the optimiser puts a filter on an
    array's size in front of a plain ``explode``, which makes the array again.
    """
    cut = texts.select("id", "tie", "row", chunks(F.col("text")).alias("chunks"))
    return stored(cut.withColumn("keys", F.transform("chunks", lambda x: F.xxhash64(x))), "line-cut", "zstd")


def repeated_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, row, place, chunk, key, words) of every chunk whose key occurs again (and of few others), stored."""
    cut = cut_rows(_rows(df, id_col, text_col))
    narrow = cut.select(F.explode_outer("keys").alias("key"))
    again = stored(narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "line-again")
    every = cut.select("id", "tie", "row", F.posexplode_outer(F.arrays_zip(F.col("keys").alias("key"), F.col("chunks").alias("chunk"))).alias("place", "x"))
    found = may_contain(every.select("id", "tie", "row", "place", "x.key", "x.chunk"), "key", candidate_filter(again, "key"))
    out = stored(found.withColumn("words", word_count(F.col("chunk"))), "line-chunks")
    dropped(cut, again)
    return out


def repeated_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, removed array<int>, removed_words) of the rows that hold repeated passages, stored."""
    found = repeated_chunks(df, id_col, text_col)
    ranked = place_rank(F.col("id"), F.col("tie"), F.col("place"))
    firsts = stored(
        found.groupBy("key", "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ranked).alias("first"))
        .where("n > 1")
        .select("key", F.md5("chunk").alias("digest"), "first", "n"),
        "line-firsts",
    )
    told = stored(found.select("id", "tie", "row", "place", "words", "key", F.md5("chunk").alias("digest")), "line-places")
    dropped(found)
    later = join_counted(told, firsts, ["key", "digest"], "n", told.count()).where(ranked > F.col("first"))
    by_place = Window.partitionBy("id", "row").orderBy("place")
    runs = later.select("id", "row", "place", "words").distinct().withColumn("run", F.col("place") - F.row_number().over(by_place))
    in_run = runs.withColumn("run_words", F.sum("words").over(Window.partitionBy("id", "row", "run")))
    removed = in_run.where(F.col("run_words") >= MIN_WORDS).groupBy("id", "row")
    out = stored(removed.agg(F.array_sort(F.collect_list("place")).alias("removed"), F.sum("words").alias("removed_words")), "line-removed")
    dropped(firsts, told)
    return out


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """``df`` with repeated passages cut out of its texts; with ``marks`` also n_removed and removed_words."""
    places = repeated_places(df, id_col, text_col)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"))
    own = whole.select("all", F.col("all")[id_col].cast("long").alias("own_id"), F.col("all")[text_col].alias("own_text"))
    keyed = own.select("all", "own_id", "own_text", row_key("own_id", "own_text")[1].alias("own_row"))
    split = marked(keyed, "own_row", candidate_filter(places, "row"), "hit")
    same = (F.col("own_row") == F.col("row")) & (F.col("own_id") == F.col("id"))
    joined = split.where("hit").join(places, same, "left").select("all", "own_text", "removed", "removed_words")
    others = split.where("not hit").select(
        "all", "own_text", F.lit(None).cast("array<int>").alias("removed"), F.lit(None).cast("long").alias("removed_words")
    )

    def without(found: Column) -> Column:
        kept_places = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("removed"))
        return F.array_join(F.transform(kept_places, lambda k: F.get(found, k)), "")

    text = F.when(F.col("removed").isNull(), F.col("own_text")).otherwise(let(chunks(F.col("own_text")), without))
    more = [
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
    ]
    kept = [text.alias(c) if c == text_col else F.col("all")[c].alias(c) for c in df.columns]
    return joined.unionByName(others).select(*kept, *(more if marks else []))
