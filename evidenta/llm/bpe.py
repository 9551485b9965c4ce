"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join neighbours that stand next to each other inside some vocabulary token.  A pair of byte symbols
that no token holds is therefore a certain cut: no merge crosses it, and the fragments on both sides can be encoded
on their own and concatenated.  White space is such a cut everywhere (no token holds it), so texts fall into words,
words into pre-tokens, and pre-tokens into fragments at every impossible pair.  Only a pre-token's last fragment
carries the word-end mark.  Words repeat, so their encodings are kept in a bounded cache.

Defined cases: a null or empty text has no tokens and decodes to the empty text; special-token strings in a text
become their special ids, as the library does; repeated rows are encoded row by row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOLDERS, arrow_map, steps, text_bytes

#: Entries that a worker's cache holds before it starts anew; bounds its memory.
CACHE_ENTRIES = 400_000


class _Memo(dict):
    """A dictionary that computes what it misses."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value


class ForcedBoundaryCodec:
    """Encoder and decoder of one tokenizer file with word ends and no decoder (tokens are joined by a space)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder") is not None or not model.get("end_of_word_suffix"):
            raise ValueError("this codec is for vocabularies with word ends and without a decoder")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.final = self.library.model
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        if any("\n" in t for t in self.tokens.values()):
            raise ValueError("this codec is for vocabularies without line feeds")
        self.joined = set()  # pairs of symbols that some token holds side by side
        for token in model["vocab"]:
            body = token.removesuffix(self.suffix)
            self.joined.update(map(str.__add__, body, body[1:]))
        self.words = _Memo(self._word)
        self.written = _Memo(self._written)

    def cuts(self, pre_token: str) -> list[str]:
        """Fragments of a pre-token between its certain cuts."""
        begin, out = 0, []
        for i in range(1, len(pre_token)):
            if pre_token[i - 1 : i + 1] not in self.joined:
                out.append(pre_token[begin:i])
                begin = i
        return [*out, pre_token[begin:]]

    def _fragment(self, fragment: str, last: bool) -> list[int]:
        return [t.id for t in (self.final if last else self.inner).tokenize(fragment)]

    def _word(self, word: bytes) -> list[int]:
        """Ids of a run of characters without ASCII white space."""
        if word.isalpha():  # bytes: ASCII letters alone
            pre_tokens = [word.decode().lower()]
        else:
            text = word.decode("utf-8")
            if any(s in text for s in self.specials):  # specials are taken out before anything is split
                return self.library.encode(text, add_special_tokens=False).ids
            text = self.library.normalizer.normalize_str(text)
            pre_tokens = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        ids: list[int] = []
        for p in pre_tokens:
            parts = self.cuts(p)
            for f in parts[:-1]:
                ids += self._fragment(f, False)
            ids += self._fragment(parts[-1], True)
        return ids

    def _written(self, word: bytes) -> bytes:
        """The ids and the decoded tokens, a space before each; a line feed, which no token holds, stands between them.

        One value instead of two in a tuple takes a third less memory.
        """
        ids = self._word(word)
        return b"".join(b" %d" % i for i in ids) + b"\n" + "".join(" " + self.tokens[i] for i in ids).encode()

    def trim(self) -> None:
        for memo in (self.words, self.written):
            if len(memo) > CACHE_ENTRIES:
                memo.clear()

    def encode(self, text: bytes) -> list[int]:
        self.trim()
        out: list[int] = []
        for w in text.split():
            out += self.words[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)

    def digest(self, text: bytes) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of the ids and of the decoded text; both joined from the words' own parts."""
        self.trim()
        parts = b"\n".join([self.written[w] for w in text.split()]).split(b"\n")
        ids, decoded = b"".join(parts[0::2])[1:], b"".join(parts[1::2])[1:]
        n = ids.count(b" ") + 1 if ids else 0
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


HOLDERS["bpe"] = codec.cache_clear


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, 1):
            ids = [codec(path).encode(t) for t in text_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(picked, run, "doc_id long, ids array<int>", "bpe")


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of every row of ids."""
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            decoded = [codec(path).decode(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoded, pa.string())], names=["doc_id", "decoded"])

    return arrow_map(picked, run, "doc_id long, decoded string", "bpe")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass without a shuffle."""
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, 1):
            rows = [codec(path).digest(t) for t in text_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(picked, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")
