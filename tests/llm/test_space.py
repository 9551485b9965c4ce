"""What operators leave in the shared folder, and rows that share an id and lead different groups."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from evidenta.llm import bpe, common, linededup, minhash, quality


def texts(n, seed=9):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(n)]


def left_by(spark, run):
    """Labels of the stored tables that are left after a result was read."""
    before = len(common._written.get(spark.sparkContext.applicationId, []))
    run().count()
    roots = [Path(root.removeprefix("file://")) for root in common._written[spark.sparkContext.applicationId][before:]]
    return Counter(p.name.removeprefix(f"{root.name}-") for root in roots for p in root.parent.glob(root.name + "*"))


def test_near_dedup_keeps_no_bands_sets_or_hits(spark):
    lines = texts(20)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, *lines[:5], *[t + " more" for t in lines[5:10]]])], "doc_id long, text string")
    left = left_by(spark, lambda: minhash.keep_one(df, minhash.Settings()))
    assert not {"sketches", "lone", "bands", "buckets", "hits", "sets", "parts"} & set(left) and left["links"] <= 2
    assert minhash.keep_one(df, minhash.Settings()).count() == 20


def test_line_dedup_keeps_no_texts(spark):
    passage = "\n".join(texts(4))
    df = spark.createDataFrame([(k, f"own {k}\n{passage}") for k in range(3)], "doc_id long, text string")
    assert set(left_by(spark, lambda: linededup.clean(df))) == {"line-removed"}


def test_rows_of_one_id_that_lead_different_groups_all_stay(spark):
    a, b, c = texts(3)
    rows = [(4, a), (4, b), (4, b), (5, a), (6, b + " more"), (7, c)]
    for order in (rows, rows[::-1]):
        out = minhash.keep_one(spark.createDataFrame(order, "doc_id long, text string"), minhash.Settings()).collect()
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(4, a), (4, b), (7, c)])


def test_a_remembered_word_is_one_value():
    """A worker keeps hundreds of thousands of words: a tuple of two values each takes half as much again."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    codec = bpe.ForcedBoundaryCodec(public_tokenizers.path("word_bpe_49k.json"))
    text = "Hello wörld,  hello don't \x01 x"
    ids = codec.library.encode(text, add_special_tokens=False).ids
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), codec.decode(ids))]
    assert codec.digest(text.encode()) == (len(ids), *digests)
    assert codec.digest(b"") == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert {type(v) for v in codec.written.values()} == {bytes}


def test_measuring_gives_memory_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "trim", lambda: calls.append(1))
    out = quality.measures_of.func(pa.array(["a b c", None]))
    assert [r["n_words"] for r in out.to_pylist()] == [3, 0] and calls == [1]
