import random

import numpy as np
import pyarrow as pa
import pytest

from evidenta.llm import wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"aeinrsTHÀÖØößü", "×", "÷", "µ", "ª", "ā", "ɏ", "ɐ", "\u0301", "ж", "中", "\U00020000", "1", "²", "\x00", "\x1c", "\u200b"]
CLOSING = [*",.;:!?%&*#$|<>'\"()-_@[]{}^`~=+/\\", "'s", "'ll", "'t", "<|endoftext|>", "|>", "...", "…", "«"]
SPACES = [" "] * 12 + ["\n", "\n", "  ", " \n", "\n ", "\t", "\r\n", "\xa0", "\u2003", "\x85", "\x0b"]


def texts(rng, n):
    for _ in range(n):
        spaces = SPACES if rng.random() < 0.3 else SPACES[:14]
        yield "".join(
            "".join(rng.choices(LETTERS, k=rng.randint(0, 4))) + "".join(rng.choices(CLOSING, k=rng.choice((0, 0, 1, 1, 2)))) + rng.choice(spaces)
            for _ in range(rng.randint(0, 12))
        ).rstrip(" " if rng.random() < 0.8 else "")


def same_as_library(made, path, found):
    library = tokenizers.Tokenizer.from_file(path)
    ids, lengths = made.encode_all(pa.array(found, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in found]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_words_cut_in_stem_and_tail_are_as_the_library_has_them(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE_ENTRIES", 3000)
    rng, made = random.Random(8), wavelet.ByteLevelEncoder(PATH, 2)
    for _ in range(12):
        same_as_library(made, PATH, [*texts(rng, 400), "", " ", "\n"])
    same_as_library(made, PATH, ["", "\t"])
    same_as_library(made, PATH, ["der Über, über. über"])


def test_a_stem_is_learnt_once_whatever_closes_it(monkeypatch):
    made, sent = wavelet.ByteLevelEncoder(PATH, 2), []
    learn = made._learn
    monkeypatch.setattr(made, "_learn", lambda keys, *a, **k: sent.extend(keys) or learn(keys, *a, **k))
    first = "a thinganstndly thinganstndly, thinganstndly.%%% thinganstndly&&&"
    same_as_library(made, PATH, [first])
    assert sent.count("thinganstndly") == 1 and not any(k.startswith("thinganstndly") and k != "thinganstndly" for k in sent)
    pieces, sent[:] = made.count, []
    same_as_library(made, PATH, [first, "a thinganstndly&&& thinganstndly.%%%"])
    assert sent == [] and made.count == pieces


def test_a_tokeniser_that_may_cut_stems_is_asked_for_whole_words(tmp_path):
    library = tokenizers.Tokenizer.from_file(PATH)
    library.add_tokens(["zzq"])
    library.save(path := str(tmp_path / "added.json"))
    made = wavelet.ByteLevelEncoder(path, 2)
    assert made.stems is None and wavelet.ByteLevelEncoder(PATH, 2).stems is not None
    same_as_library(made, path, ["one two, two. azzq, azzq"])


def test_a_batch_a_little_longer_than_a_step_leaves_no_short_shards(monkeypatch, spark):
    """Shards are filled over steps, and all rows come back in their order."""
    runs = []
    monkeypatch.setattr(wavelet, "arrow_map", lambda df, run, *a: runs.append(run))
    monkeypatch.setattr(wavelet, "stored", lambda df, label: df)
    monkeypatch.setattr(wavelet, "ENCODE_BYTES", 2000)
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 600)
    wavelet.write_shards(spark.createDataFrame([(1, "x")], "doc_id long, text string"), PATH, 2)
    words = [f"w{i} and so it goes on" for i in range(400)]
    words[100], words[200] = " ".join(["long"] * 900), None
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(b, b + 100), pa.int64()), pa.array(words[b : b + 100], pa.string()), pa.array([0] * 100, pa.int32())], names=["doc_id", "text", "part"])
        for b in range(0, 400, 100)
    ]
    files = [x for out in runs[0](iter(batches)) for x in out.to_pylist()]
    assert [f["seq"] for f in files] == list(range(len(files))) and sum(f["docs"] for f in files) == 400
    library, read = tokenizers.Tokenizer.from_file(PATH), []
    for f in files:
        matrix, ids, _, lengths = wavelet.WaveletMatrix.from_bytes(f["file"])
        read += zip(ids.tolist(), np.split(matrix.decode(), np.cumsum(lengths)[:-1]), strict=True)
        assert f["tokens"] <= 600 or f["docs"] == 1
    assert [i for i, _ in read] == list(range(400))
    assert all(x.tolist() == library.encode(words[i] or "", add_special_tokens=False).ids + [2] for i, x in read)
    sizes = [f["tokens"] for f in files]
    assert all(a + b > 600 for a, b in zip(sizes, sizes[1:]))
