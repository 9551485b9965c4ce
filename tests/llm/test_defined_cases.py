"""The defined cases of every operator and every pipeline stage: nulls, empty and long texts, repeated rows, shared ids,
an empty table, and extra columns named like any column that an operator uses inside."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import evidenta.llm
from evidenta.llm import bpe, exactdedup, langid, linededup, minhash, mixing, quality, secrets, sharding, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_PATH, BYTE_PATH = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BASE = ["doc_id", "text", "lang", "source", "n_chars"]

OPERATORS = {
    "op1": lambda d: sharding.shard_documents(d, 3),
    "op2": mixing.mix,
    "op3": langid.identify,
    "op4": lambda d: bpe.round_trip_digests(d, WORD_PATH),
    "op5": secrets.find_secrets,
    "op6": lambda d: minhash.near_duplicates(d, minhash.Settings(words=3, over=85)),
    "op7": exactdedup.equal_groups,
    "op8": lambda d: wavelet.round_trip(d, BYTE_PATH),
    "op9": linededup.clean,
    "op10": quality.judge,
}


def stages():
    import corpus_pipeline

    return {name: (lambda d, stage=stage: stage(d.sparkSession, d, "")) for name, stage in corpus_pipeline.STAGES}


ALL = [*OPERATORS, "quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_round_trip"]


def applied(name):
    return OPERATORS[name] if name in OPERATORS else stages()[name]


def inner_names():
    """Every name that the operators' modules give or ask a column, read from their sources."""
    found = set()
    for path in Path(evidenta.llm.__file__).parent.glob("*.py"):
        if path.stem not in ("oracles", "queries"):
            found |= set(re.findall(r'"([a-z_][a-z_0-9]*)"', path.read_text()))
    return sorted(found - set(BASE))


def prose(n, k=60):
    return " ".join(f"w{n}x{i}," if i % 6 == 5 else f"w{n}x{i}" for i in range(k))


def awkward():
    """Nulls in each column, empty texts, equal rows, rows that share an id (equal, near and other texts), one long text."""
    a, b = prose(1), prose(2)
    long = " ".join(f"long{i % 9973}" for i in range(120_000))
    rows = [
        (0, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "fr", "t", 1), (1, b, "fr", "t", 1), (2, a.replace("w1x3 ", "other "), "en", "s", 1),
        (2, None, "en", "s", 1), (3, "", "en", "t", 1), (3, "", "en", "t", 1), (None, a, None, None, None), (None, None, None, None, None),
        (4, b + "\n" + a, None, "s", None), (4, prose(3), "fr", None, 1), (5, long, "en", "s", 1), (6, long, "en", "t", 1), (7, " \n\t", "en", "s", 1),
        (8, "token = Zk3vQ9xT7mB2nR8pL5wD1 and Qw8eRt6yUi4oPa2sDf9gH", "en", "s", 1), (9, "² ³ ¹", "fr", "s", 1), (10, prose(4), "en", "s", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(awkward(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def told(df, columns):
    return Counter(tuple(map(str, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", ALL)
def test_columns_of_any_name_change_nothing(plain, name):
    """The same rows with an extra column for every inner name, of a type that no operator would take for its own."""
    run = applied(name)
    clashing = plain.select(*BASE, *[F.array(F.lit("clash")).alias(c) for c in inner_names()])
    expected = run(plain)
    got = run(clashing)
    kept = [c for c in expected.columns]
    assert told(got, kept) == told(expected, kept)
    if name in ("op9", "quality_rules", "line_dedup", "near_dedup", "mix_sources"):
        assert got.columns == clashing.columns


@pytest.mark.parametrize("name", ALL)
def test_an_empty_table_gives_an_empty_result(plain, name):
    assert applied(name)(plain.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op7", "op9"])
def test_every_row_has_its_result_in_any_order(plain, name):
    run = OPERATORS[name]
    found = run(plain)
    key = "id" if "id" in found.columns else "doc_id"
    assert Counter(r[0] for r in found.select(key).collect()) == Counter(r[0] for r in awkward())
    if name != "op1":  # equal rows share a shard, but which of them has which slot is open
        assert told(run(plain.repartition(5, "n_chars")), found.columns) == told(found, found.columns)


def test_rows_that_share_an_id_are_told_apart(plain):
    exact = exactdedup.equal_groups(plain).collect()
    assert Counter((r["id"], r["group_size"]) for r in exact if r["id"] == 1) == Counter([(1, 3), (1, 2), (1, 2)])
    near = minhash.near_duplicates(plain, minhash.Settings(words=3, over=85)).collect()
    assert Counter((r["id"], r["n"], r["component"]) for r in near if r["id"] in (1, 2)) == Counter([(1, 58, 0), (1, 58, 1), (1, 58, 1), (2, 58, 0), (2, 0, 2)])
    cleaned = Counter((r["doc_id"], r["text"]) for r in linededup.clean(plain).collect())
    assert cleaned[(1, prose(2))] == 2 and cleaned[(4, prose(3))] == 1 and cleaned[(1, "")] == 1
    labelled = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(plain).collect())
    assert sum(n for (i, _), n in labelled.items() if i == 1) == 3 and labelled[(9, "und")] == 1
    slots = Counter((r["shard"], r["slot"]) for r in sharding.shard_documents(plain, 3).collect())
    assert max(slots.values()) == 1


def test_stages_keep_and_drop_as_they_say(plain):
    run = stages()
    good = Counter(r["doc_id"] for r in run["quality_rules"](plain).collect())
    assert good == Counter({0: 1, 1: 3, 2: 1, None: 1, 4: 2, 10: 1})
    cut = Counter((r["doc_id"], r["text"]) for r in run["line_dedup"](plain).collect())
    assert cut[(0, prose(1))] == 1 and cut[(1, prose(2))] == 2 and not any(i == 3 or t == "" for i, t in cut) and cut[(None, prose(1))] == 1
    one = Counter((r["doc_id"], r["text"]) for r in run["near_dedup"](plain).collect())
    assert one[(0, prose(1))] == 1 and one[(1, prose(1))] == 0 and one[(1, prose(2))] == 1 and one[(4, prose(3))] == 1
    assert one[(3, "")] == 2 and one[(2, None)] == 1 and one[(None, prose(1))] == 1 and one[(6, awkward()[13][1])] == 0
    mixed = run["mix_sources"](plain)
    assert mixed.columns == BASE and {r["source"] for r in mixed.collect()} == {"s", "t", None}
