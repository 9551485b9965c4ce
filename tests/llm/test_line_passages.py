import random

import pytest

from evidenta.llm import linededup


def words_of(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.randrange(10**6)}" for _ in range(n)]


def prose(rng, words, line):
    """Words in lines of ``line``, with punctuation now and then."""
    out = []
    for i, w in enumerate(words):
        mark = rng.choice([",", ".", "", "", "", "", ""])
        out.append(w + mark + ("\n" if (i + 1) % line == 0 else " "))
    return "".join(out).strip()


def remaining(text, passage):
    left = set(text.split())
    return sum(w in left for w in passage.split())


@pytest.mark.parametrize("line", [6, 30, 500])
@pytest.mark.parametrize("size, share", [(60, 0.8), (120, 0.97)])
def test_repeated_passages_are_caught_whatever_their_lines(spark, line, size, share):
    """Of 60 passages that two documents hold, in short lines, long lines or inside one line, most lose most of a copy."""
    rng = random.Random(line * size)
    rows, passages = [], []
    for k in range(60):
        passage = prose(rng, words_of(rng, size), line)
        passages.append(passage)
        gap = " " if line == 500 else "\n"
        for side in range(2):
            own = [prose(rng, words_of(rng, 40), 12) for _ in range(2)]
            rows.append((2 * k + side, f"{own[0]}{gap}{passage}{gap}{own[1]}"))
    got = {r["doc_id"]: r["text"] for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == rows[2 * k][1] for k in range(60))
    cut = [remaining(got[2 * k + 1], p) <= 0.7 * size for k, p in enumerate(passages)]
    assert sum(cut) >= share * 60
    for k in range(60):  # nothing but words of the passage goes, but for the lines around it
        own = [w for w in rows[2 * k + 1][1].split() if w not in passages[k].split()]
        assert all(w in got[2 * k + 1].split() for w in own)


@pytest.mark.parametrize("n, length", [(3, 40), (6, 45), (20, 9)])
def test_blank_lines_between_short_paragraphs_break_no_run(spark, n, length):
    rng = random.Random(n)
    passage = "\n\n".join(" ".join(words_of(rng, length)) for _ in range(n))
    texts = [f"own line {k} of its document and nothing else\n\n{passage}\n\nend of {k} which no other document has" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.clean(docs, marks=True).collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_removed"] == 0
    for k in (1, 2):
        assert got[k]["removed_words"] >= n * length - 40
        assert got[k]["text"].startswith(f"own line {k} of") and got[k]["text"].endswith("no other document has")


def test_short_repeats_stay(spark):
    texts = [f"Dear reader,\n\n{' '.join(words_of(random.Random(k), 40))}\n\nYours sincerely,\nThe editor" for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.clean(docs).collect()} == dict(enumerate(texts))


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    rng = random.Random(4)
    passage = prose(rng, words_of(rng, 90), 10)
    unique = "\n".join(" ".join(words_of(rng, 10)) for _ in range(4))
    rows = [(1, passage), (2, "before\n" + passage), (2, unique), (None, passage), (3, unique), (3, unique)]
    out = linededup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in out)
    assert texts[0] == (-1, passage) and texts[1] == (1, passage)
    assert (2, unique) in texts and len(texts) == 6
    assert [t for i, t in texts if i == 3] == ["", ""]
    assert next(len(t) for i, t in texts if i == 2 and t != unique) < len(passage) / 3


def test_texts_are_cut_once_to_find_repeats(spark, monkeypatch):
    """No plan cuts a text for its keys and again for its chunks, nor in a filter that the optimiser adds."""
    plans, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, *a))
    rng = random.Random(5)
    passage = prose(rng, words_of(rng, 90), 10)
    docs = spark.createDataFrame([(k, f"own {k}\n{passage}") for k in range(3)], "doc_id long, text string")
    assert linededup.repeated_chunks(docs, "doc_id", "text").count() > 0
    assert sum(p.count(linededup.SOFT_LINE) for p in plans) == 1
