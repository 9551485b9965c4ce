import hashlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_follow_each_other(spark, docs, tmp_path):
    """Every stage works on what its predecessor kept, and the last one's digests are those of the rows it was given."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from tests.llm.test_operators import brute_clean, brute_components, brute_measures, words

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES:
        now = stage(spark, now, str(tmp_path))
        path = str(tmp_path / f"out-{name}")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept.append(now.collect())
        if name != P.STAGES[-1][0]:
            assert now.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i, t in texts.items() if (m := brute_measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert {r["doc_id"] for r in kept[0]} <= good
    cleaned = brute_clean({r["doc_id"]: r["text"] for r in kept[0]})
    assert {r["doc_id"]: r["text"] for r in kept[1]} == {i: t for i, t in cleaned.items() if words(t)}
    groups = brute_components({r["doc_id"]: r["text"] for r in kept[1]}, 5, 80)
    assert {r["doc_id"] for r in kept[2]} == {i for i, (_, root) in groups.items() if root == i}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter((r["doc_id"], hashlib.sha256(" ".join(map(str, library.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest()) for r in kept[3])
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in kept[4]) == expected
    run = P.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in run) == expected
