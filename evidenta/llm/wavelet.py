"""Token-ID output as one wavelet-matrix file per shard.

Documents are encoded in ascending id order, an end id closes each, and the ids of about SHARD_TOKENS tokens become
one file: a header, the shard's alphabet with counts and code lengths, one packed bit plane per bit of a Huffman code (tokens
with a zero bit move before those with a one bit, stably, on the way to the next plane, and those whose code ends leave
at the end), a rank directory over each plane, and the documents' ids and lengths.  From the file alone a reader can access any token, count a token in a range and find its
occurrences.  Files are rows of a table in the shared folder (one binary cell each), so any store that Spark reaches
holds them.

The query reads every file back: all ids by the bulk decoder, each document's last id by ``access`` (it has to be the end
id, else the file is broken) and the end ids inside each document by ``rank``.

Defined cases: a null or empty text is the end id alone; rows that share an id follow one another in the order of
their texts' hashes, equal rows are written twice; null ids come first; a very long text is one document of a shard of
its own (a shard holds whole documents); ties do not occur; an empty table gives no file; special-token strings in a
text become their special ids, as the library does; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOLDERS, arrow_map, joined, steps, stored

SHARD_TOKENS = 1 << 20
CACHE_ENTRIES = 900_000
#: Bytes of text that are cut into words at a time.
ENCODE_BYTES = 4_000_000
#: New words that go to the library at a time.
LEARN_WORDS = 1_000
#: Bits between two entries of a plane's rank directory.
RANK_BITS = 512
#: First bits of a block's words, and positions that are ranked at a time.
WORD_AT, RANK_STEP = np.arange(0, RANK_BITS, 64), 1 << 15
MAGIC = b"WVM1"
HEADER = struct.Struct("<4sQIIQ")

# White space as the byte-level pre-tokeniser's pattern has it, and the Latin ones of its letters.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LETTERS = "".join(filter(re.compile(f"[{LATIN}]").match, map(chr, range(0x250))))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code in a Huffman code; one symbol alone has one bit."""
    if len(counts) < 2:
        return np.ones(len(counts), dtype=np.uint8)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(counts) - 1, dtype=np.int64)
    node = len(counts)
    while len(heap) > 1:
        x, i = heapq.heappop(heap)
        y, j = heap[0]
        parent[i] = parent[j] = node
        heapq.heapreplace(heap, (x + y, node))
        node += 1
    depth = np.zeros(node, dtype=np.uint8)
    for i in range(node - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[: len(counts)]


class Codes:
    """Code words for a wavelet matrix: at every level the words that end there stand last.

    The nodes of a level are the nodes of the one before with a zero bit, then with a one bit; of these the last ones
    become leaves.  A level's array is grouped by its nodes in that order, so what ends is its tail and the positions
    of what goes on do not change.
    """

    def __init__(self, counts: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.levels = int(lengths.max()) if len(lengths) else 0
        self.bits = [np.zeros(len(counts), dtype=bool) for _ in range(self.levels)]
        self.leaves: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
        self.sizes = [int(counts.sum())]
        nodes = np.zeros(1, dtype=np.int64)  # paths, the first step as the highest bit
        for level in range(self.levels):
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            ending = np.flatnonzero(lengths == level + 1)
            keep = len(nodes) - len(ending)
            for k in range(level + 1):
                self.bits[k][ending] = nodes[keep:] >> (level - k) & 1
            nodes = nodes[:keep]
            self.leaves.append(ending)
            self.sizes.append(self.sizes[-1] - int(counts[ending].sum()))


class WaveletMatrix:
    """Succinct sequence of token ids, Huffman-shaped, with access, rank, count and select."""

    def __init__(self, alphabet: np.ndarray, counts: np.ndarray, lengths: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.alphabet, self.counts, self.planes, self.ranks = alphabet, counts.astype(np.int64), planes, ranks
        self.codes = Codes(self.counts, lengths)
        self.n = self.codes.sizes[0]
        self._rows: dict[int, np.ndarray] = {}

    @property
    def levels(self) -> int:
        return len(self.planes)

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        every = np.bincount(tokens) if len(tokens) else np.zeros(1, dtype=np.int64)
        alphabet = np.flatnonzero(every).astype(np.uint32)
        counts = every[alphabet]
        lengths = code_lengths(counts)
        codes = Codes(counts, lengths)
        # tokens are held as their codes, the bit of the level as the sign
        kind, signed, top = (np.uint32, np.int32, 31) if codes.levels <= 32 else (np.uint64, np.int64, 63)
        code = np.zeros(len(every), dtype=kind)
        for level, bits in enumerate(codes.bits):
            code[alphabet] |= bits.astype(kind) << kind(top - level)
        now = code[tokens]
        planes, ranks = [], []
        for level in range(codes.levels):
            bits = now.view(signed) < 0
            plane = np.packbits(bits)
            planes.append(plane)
            ranks.append(_directory(plane))
            # compress finds the places without a branch per token, several times faster than indexing by a mask
            now = np.concatenate([np.compress(~bits, now), np.compress(bits, now)])[: codes.sizes[level + 1]]
            now <<= kind(1)
        return cls(alphabet, counts, lengths, planes, ranks)

    def to_bytes(self, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray) -> bytes:
        parts = [HEADER.pack(MAGIC, self.n, len(self.alphabet), self.levels, len(doc_ids)), self.alphabet.astype("<u4").tobytes()]
        parts += [self.counts.astype("<u8").tobytes(), self.codes.lengths.astype("u1").tobytes()]
        for plane, rank in zip(self.planes, self.ranks, strict=True):
            parts += [plane.tobytes(), rank.astype("<u4").tobytes()]
        parts += [doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), lengths.astype("<u8").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
        """(matrix, document ids, which of them are not null, tokens of each document)."""
        magic, _, sigma, levels, docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = HEADER.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        alphabet, counts, lengths = take("<u4", sigma), take("<u8", sigma), take("u1", sigma)
        planes, ranks, left = [], [], int(counts.sum())
        for level in range(levels):
            planes.append(take("u1", (left + 7) // 8))
            ranks.append(take("<u4", len(planes[-1]) * 8 // RANK_BITS + 1))
            left -= int(counts[lengths == level + 1].sum())
        matrix = cls(alphabet, counts, lengths, planes, ranks)
        return matrix, take("<i8", docs), take("u1", docs).astype(bool), take("<u8", docs).astype(np.int64)

    def _words(self, level: int) -> np.ndarray:
        """A plane as rows of 64-bit words, one row for each entry of the rank directory."""
        if level not in self._rows:
            plane = self.planes[level]
            padded = np.zeros(len(self.ranks[level]) * (RANK_BITS // 8), dtype=np.uint8)
            padded[: len(plane)] = plane
            self._rows[level] = padded.view(">u8").astype(np.uint64).reshape(-1, RANK_BITS // 64)
        return self._rows[level]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """One bits before positions i of a plane: the directory's entry, then the words of its block."""
        words, i = self._words(level), np.asarray(i, dtype=np.int64)
        block = i // RANK_BITS
        out = self.ranks[level][block].astype(np.int64)
        for begin in range(0, len(i), RANK_STEP):
            part = slice(begin, begin + RANK_STEP)
            bits = np.clip(i[part, None] % RANK_BITS - WORD_AT, 0, 64)
            head = words[block[part]] >> np.minimum(64 - bits, 63).astype(np.uint64)
            out[part] += np.bitwise_count(np.where(bits > 0, head, np.uint64(0))).sum(axis=1, dtype=np.int64)
        return out

    def _zeros(self, level: int) -> int:
        size = self.codes.sizes[level]
        return size - int(self._ones(level, np.array([size]))[0])

    def access(self, i) -> np.ndarray:
        """Token ids at positions i."""
        i = np.atleast_1d(np.asarray(i, dtype=np.int64)).copy()
        out, open_ = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        for level in range(self.levels):
            bit = (self.planes[level][i // 8] >> (7 - i % 8).astype(np.uint8)) & 1
            ones = self._ones(level, i)
            i = np.where(bit == 1, self._zeros(level) + ones, i - ones)
            tail = i - self.codes.sizes[level + 1]
            done = tail >= 0
            ends = np.cumsum(self.counts[self.codes.leaves[level + 1]])
            out[open_[done]] = self.codes.leaves[level + 1][np.searchsorted(ends, tail[done], side="right")]
            i, open_ = i[~done], open_[~done]
        return self.alphabet[out]

    def _symbol(self, token: int) -> int | None:
        s = int(np.searchsorted(self.alphabet, token))
        return s if s < len(self.alphabet) and self.alphabet[s] == token else None

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range."""
        s, end = self._symbol(token), self.n if end is None else end
        if s is None:
            return 0
        for level in range(int(self.codes.lengths[s])):
            ones = self._ones(level, np.array([begin, end]))
            if self.codes.bits[level][s]:
                begin, end = (self._zeros(level) + int(k) for k in ones)
            else:
                begin, end = begin - int(ones[0]), end - int(ones[1])
        return end - begin

    def rank(self, token: int, positions: np.ndarray) -> np.ndarray:
        """Occurrences of a token before each of the positions."""
        s, at = self._symbol(token), np.asarray(positions, dtype=np.int64).copy()
        if s is None:
            return np.zeros(len(at), dtype=np.int64)
        begin = 0
        for level in range(int(self.codes.lengths[s])):
            ones = self._ones(level, np.append(at, begin))
            if self.codes.bits[level][s]:
                zeros = self._zeros(level)
                at, begin = zeros + ones[:-1], zeros + int(ones[-1])
            else:
                at, begin = at - ones[:-1], begin - int(ones[-1])
        return at - begin

    def select(self, token: int) -> np.ndarray:
        """Positions of all occurrences of a token."""
        s = self._symbol(token)
        if s is None:
            return np.empty(0, dtype=np.int64)
        depth = int(self.codes.lengths[s])
        leaves = self.codes.leaves[depth]
        own = int(np.searchsorted(leaves, s))
        first = self.codes.sizes[depth] + int(self.counts[leaves[:own]].sum())
        at = np.arange(first, first + int(self.counts[s]))
        for level in reversed(range(depth)):
            bits = np.unpackbits(self.planes[level], count=self.codes.sizes[level]).view(bool)
            one = bool(self.codes.bits[level][s])
            at = np.flatnonzero(bits == one)[at - (self._zeros(level) if one else 0)]
        return at

    def decode(self) -> np.ndarray:
        """All token ids, from the last plane back to the first."""
        small = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        now = np.empty(0, dtype=small)
        for level in reversed(range(self.levels)):
            leaves = self.codes.leaves[level + 1]
            now = np.concatenate([now, np.repeat(leaves.astype(small), self.counts[leaves])])
            bits = np.unpackbits(self.planes[level], count=len(now)).view(bool)
            out = np.empty_like(now)
            ones = np.flatnonzero(bits)
            zeros = len(now) - len(ones)
            out[np.flatnonzero(~bits)] = now[:zeros]
            out[ones] = now[zeros:]
            now = out
        return self.alphabet[now]


def _directory(plane: np.ndarray) -> np.ndarray:
    """One bits before each RANK_BITS bits of a plane."""
    step = RANK_BITS // 8
    ones = np.bitwise_count(np.concatenate([plane, np.zeros(-len(plane) % step, dtype=np.uint8)]))
    totals = np.cumsum(ones.reshape(-1, step).sum(axis=1, dtype=np.int64)) if len(ones) else np.empty(0, dtype=np.int64)
    return np.concatenate([[0], totals])[: len(plane) * 8 // RANK_BITS + 1].astype(np.uint32)


class ByteLevelEncoder:
    """The library's byte-level encoding, from remembered pieces.

    A text is cut before each run of white space that follows another character.  The pre-tokeniser always has a
    boundary there: what comes before never reaches into white space, and a token only starts with it.  In plain
    texts (single spaces and line feeds between words) the pieces are the words themselves, each with its one space
    or line feed in front; they are cut and numbered by Arrow, so only new words are seen by Python.  New words go to
    the library together: a token that starts with a space starts a word.

    A word of Latin letters that ASCII punctuation follows is two pieces, stem and tail: the pre-tokeniser takes a run of
    letters whole, and what follows is cut as if it stood alone.  So a stem is learnt once, whatever closes it, and
    new stems go to the library's model without the pre-tokeniser's pattern, which would not cut them.

    The ids of all remembered pieces stand in one array; a text is a list of piece numbers until its ids are gathered.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.lined = np.array([(self.library.id_to_token(i) or "").startswith("\u010a") for i in range(size)])
        self.split = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.end_id = end_id
        self.stems = self._stem_library()
        self.forget()

    def _stem_library(self):
        """The library's model behind a cut at spaces alone; None where its own steps are not known to leave stems whole."""
        from tokenizers import Tokenizer, pre_tokenizers

        known = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        whole = known.get("type") == "ByteLevel" and known.get("use_regex") and not known.get("add_prefix_space")
        word = re.compile(f"[{LATIN}]*[{re.escape(string.punctuation)}]*")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if not whole or self.library.normalizer is not None or any(map(word.fullmatch, added)):
            return None
        out = Tokenizer(self.library.model)
        spaced = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), spaced])
        return out

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # words and stems after one space; what starts with a line feed stands for itself
        self.heads: dict[str, int] = {}  # first words of texts, after nothing
        self.pieces: dict[str, int] = {}  # of any form
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.starts, self.used, self.count = np.zeros(1 << 14, dtype=np.int64), 0, 0
        self.seen = np.zeros(1 << 14, dtype=np.int32)  # steps that used a piece
        self.passing = 0  # last pieces, which go after the step
        self.end = self._remember(np.array([self.end_id], dtype=np.uint32), [0])

    def shrink(self) -> None:
        """Forget what only one step has used: most new words never come again.  Forget all if that is not enough."""
        ids, starts, seen = self.ids, self.starts, self.seen
        old = {name: getattr(self, name) for name in ("words", "heads", "pieces")}
        self.forget()
        for name, numbers in old.items():
            keys = [k for k, n in numbers.items() if seen[n] > 1]
            if len(keys) > CACHE_ENTRIES // 2:
                continue
            kept = np.fromiter(map(numbers.__getitem__, keys), dtype=np.int64, count=len(keys))
            first = self._remember(*gathered(ids, starts, kept)[:2])
            getattr(self, name).update(zip(keys, range(first, first + len(keys)), strict=True))
            self.seen[first : first + len(keys)] = 1

    def _remember(self, ids: np.ndarray, begins: list[int] | np.ndarray) -> int:
        """Append pieces that begin at ``begins`` of ``ids``; the number of the first."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + len(begins) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.count : self.count + len(begins)] = np.asarray(begins) + self.used
        first, self.used, self.count = self.count, self.used + len(ids), self.count + len(begins)
        self.starts[self.count] = self.used
        return first

    def _piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            ids = self.library.encode(piece, add_special_tokens=False).ids
            found = self.pieces[piece] = self._remember(np.array(ids, dtype=np.uint32), [0])
        return found

    def _learn(self, keys: list[str], mark: str, into: dict[str, int], whole: bool, cut: int = 0, library=None) -> np.ndarray:
        """Encode new words together, each behind the mark (a space or a line feed); its token starts a word.

        With ``whole`` the mark belongs to the word (a space merges into its first token); without, it is a token of
        its own and left out.  A key's first ``cut`` characters are not of the word.  Returns the piece numbers.
        """
        starts = self.spaced if mark == " " else self.lined
        out = np.empty(len(keys), dtype=np.int64)
        for begin in range(0, len(keys), LEARN_WORDS):
            part = keys[begin : begin + LEARN_WORDS]
            text = mark + mark.join([k[cut:] for k in part] if cut else part)
            ids = np.array((library or self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            begins = np.flatnonzero(starts[ids])
            if len(begins) != len(part):
                raise AssertionError("a word has other than one token that starts with its mark")
            if not whole:
                keep = np.ones(len(ids), dtype=bool)
                keep[begins] = False
                ids, begins = ids[keep], begins - np.arange(len(begins))
            first = self._remember(ids, begins)
            into.update(zip(part, range(first, first + len(part)), strict=True))
            out[begin : begin + len(part)] = np.arange(first, first + len(part))
        return out

    def _look_up(self, keys: list[str], into: dict[str, int], learn: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """The piece number of each of the keys, all different."""
        found = np.fromiter(map(into.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        if len(fresh := np.flatnonzero(found < 0)):
            found[fresh] = learn(list(map(keys.__getitem__, fresh.tolist())))
        self.seen[found] += 1
        return found

    def _learn_words(self, new: list[str]) -> np.ndarray:
        lined = np.array([w[:1] == "\n" for w in new])
        stem = is_stem(pa.array(new, pa.string())) if self.stems else np.zeros(len(new), dtype=bool)
        out = np.empty(len(new), dtype=np.int64)
        out[stem] = self._learn(chosen(new, stem), " ", self.words, True, library=self.stems)
        out[~lined & ~stem] = self._learn(chosen(new, ~lined & ~stem), " ", self.words, True)
        out[lined] = self._learn(chosen(new, lined), "\n", self.words, True, cut=1)
        return out

    def _learn_heads(self, new: list[str]) -> np.ndarray:
        return self._learn(new, "\n", self.heads, False)

    def _of_words(self, words: pa.Array) -> np.ndarray:
        """The piece number of each word, all different; stem and tail become one piece for this step."""
        if not self.stems:
            return self._look_up(strings(words), self.words, self._learn_words)
        stems = pa.compute.utf8_rtrim(words, string.punctuation)
        cut = is_stem(stems)
        keys = pa.compute.if_else(pa.array(cut), stems, words).dictionary_encode()
        out = self._look_up(strings(keys.dictionary), self.words, self._learn_words)[keys.indices.to_numpy(zero_copy_only=False)]
        tails = pa.compute.utf8_ltrim(words.filter(pa.array(cut)), LETTERS).dictionary_encode()
        table = np.array([self._piece(t) if t else -1 for t in strings(tails.dictionary)], dtype=np.int64)
        tail = np.full(len(words), -1, dtype=np.int64)
        tail[cut] = table[tails.indices.to_numpy(zero_copy_only=False)]
        if len(closed := np.flatnonzero(tail >= 0)):
            ids, begins, _ = gathered(self.ids, self.starts, np.stack([out[closed], tail[closed]], axis=1).ravel())
            out[closed] = self._remember(ids, begins[::2]) + np.arange(len(closed))
            self.passing = len(closed)
        return out

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all texts, the end's at the end of each; numbers of each text)."""
        plain = is_plain(texts)
        odd = [np.array([*map(self._piece, self.split(t)), self.end], dtype=np.int64) for t in strings(texts.filter(pa.array(~plain)))]
        lengths = np.empty(len(texts), dtype=np.int64)
        lengths[~plain] = [len(x) for x in odd]
        if not plain.any():
            return np.concatenate(odd), lengths
        spaced = pa.compute.replace_substring(texts.filter(pa.array(plain)), "\n", " \n")
        cut = pa.compute.split_pattern(spaced, " ")
        offsets = cut.offsets.to_numpy()
        offsets, words = offsets - offsets[0], cut.flatten()
        first = offsets[:-1]
        heads = words.take(pa.array(first)).dictionary_encode()
        head = self._look_up(strings(heads.dictionary), self.heads, self._learn_heads)[heads.indices.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        numbers = self._of_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        numbers[first] = head
        numbers = np.insert(numbers, offsets[1:], self.end)
        lengths[plain] = np.diff(offsets) + 1
        if odd:
            own, mixed = np.repeat(plain, lengths), np.empty(int(lengths.sum()), dtype=np.int64)
            mixed[own], mixed[~own] = numbers, np.concatenate(odd)
            numbers = mixed
        return numbers, lengths

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text); every text is closed by the end id."""
        if len(self.words) + len(self.heads) + len(self.pieces) > CACHE_ENTRIES:
            self.shrink()
        numbers, lengths = self._numbers(texts)
        ids, _, upto = gathered(self.ids, self.starts, numbers)
        self.count, self.passing = self.count - self.passing, 0
        self.used = int(self.starts[self.count])
        return ids, np.diff(upto[np.cumsum(lengths) - 1], prepend=0)


def gathered(ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the pieces one after another, where each begins, where each ends)."""
    begins = starts[numbers]
    sizes = starts[numbers + 1] - begins
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
    return ids[at], ends - sizes, ends


def chosen(values: list[str], mask: np.ndarray) -> list[str]:
    return list(itertools.compress(values, mask.tolist()))


def strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar per value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _pattern(chars: str) -> str:
    """A class of characters as Arrow's patterns have it."""
    return "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in chars)


_OTHER_WHITE = "\t\x0b-\r" + WHITE.removeprefix("\t-\r ")
_ODD = rf"^$|^[ \n]|[ \n]$|[ \n][ \n]|[{_pattern(_OTHER_WHITE)}]"
_STEM = f"^[{_pattern(LATIN)}]+$"


def is_plain(texts: pa.Array) -> np.ndarray:
    """Whether white space is single spaces and line feeds between other characters."""
    return ~pa.compute.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)


def is_stem(words: pa.Array) -> np.ndarray:
    """Whether a word is of Latin letters alone."""
    return pa.compute.match_substring_regex(words, _STEM).to_numpy(zero_copy_only=False)


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> ByteLevelEncoder:
    return ByteLevelEncoder(path, end_id)


HOLDERS["wavelet"] = encoder.cache_clear


def write_shards(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, seq, first_id, docs, tokens, file) in the shared folder, one row per shard file.

    Documents are range-partitioned by id, so shards hold consecutive ids.
    """
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    names = ["part", "seq", "first_id", "docs", "tokens", "file"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def shard(part: int, seq: int, ids: list[int | None], tokens: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        valid = np.array([i is not None for i in ids])
        made = WaveletMatrix.build(tokens).to_bytes(np.array([i or 0 for i in ids], dtype=np.int64), valid, lengths)
        values = ([part], [seq], [ids[0]], [len(ids)], [len(tokens)], [made])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, tokens, sizes = 0, 0, [], np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        # twice: a batch is about ENCODE_BYTES long, and a little more should not become a step of its own
        for b in steps(joined(batches, ENCODE_BYTES), 1, 2 * ENCODE_BYTES):
            more, counts = encoder(path, end_id).encode_all(pa.compute.fill_null(b.column(1), ""))
            part, ids = b.column(2)[0].as_py(), ids + b.column(0).to_pylist()
            tokens, sizes = np.concatenate([tokens, more]), np.concatenate([sizes, counts])
            upto, begin, base = np.cumsum(sizes), 0, 0
            while len(tokens) - base > SHARD_TOKENS:
                end = max(begin + 1, int(np.searchsorted(upto, base + SHARD_TOKENS, side="right")))
                yield shard(part, seq, ids[begin:end], tokens[base : upto[end - 1]], sizes[begin:end])
                begin, base, seq = end, int(upto[end - 1]), seq + 1
            ids, tokens, sizes = ids[begin:], tokens[base:].copy(), sizes[begin:]
        if ids:
            yield shard(part, seq, ids, tokens, sizes)

    return stored(arrow_map(ordered, run, "part int, seq long, first_id long, docs long, tokens long, file binary", "wavelet"), "tokens")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): tokens before each shard, from prefix sums inside each part and over the parts' totals."""
    narrow = shards.select("part", "seq", "tokens")
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    totals = narrow.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")
    firsts = totals.select(F.col("part").alias("p"), before.alias("part_base"))
    return narrow.withColumn("inside", inside).join(firsts, F.col("part") == F.col("p")).select(
        "part", "seq", (F.col("part_base") + F.col("inside")).alias("base")
    )


def read_documents(shards: DataFrame, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_end_ids) of every document, read from the files.

    The files are decoded where they are read; only the documents' narrow rows meet the shards' first positions.
    """
    files = shards.select("part", "seq", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                matrix, ids, valid, lengths = WaveletMatrix.from_bytes(data)
                ends = np.cumsum(lengths)
                if (matrix.access(ends - 1) != end_id).any():
                    raise ValueError(f"file {seq} of part {part} is broken: a document does not close with the end id")
                end_ids = matrix.rank(end_id, ends) - matrix.rank(end_id, ends - lengths)
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(np.full(len(ids), seq, dtype=np.int64)),
                        pa.array(ids, mask=~valid), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(end_ids),
                    ],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "n_end_ids"],
                )

    found = arrow_map(files, run, "part int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long, n_end_ids long", "wavelet")
    placed = found.join(shard_starts(shards), ["part", "seq"])
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids")


def round_trip(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_documents(write_shards(df, path, end_id, id_col, text_col), end_id)
