"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language label by forward-backward over the whole text.  A word's score for a label is the
sum of the weights of its features: character n-grams (1 to 4, with word boundaries), affixes (the n-grams that touch a
boundary), and a lexicon (the word itself, and the label that dominates it in the training sample).  Label
transitions are learned with the weights, from training chains that splice spans of texts in different languages, so
that code-switched text is labelled word by word.  A document's language is the label with the most expected words;
its score is that label's share.

Texts are worked in blocks of BLOCK words only to do many at once: a block's transfer matrix carries the messages of
forward-backward over its edges, so the marginals are those of one unbroken chain.

The field is fitted on the driver on a bounded sample: at most TRAIN_DOCS labelled documents, dealt evenly over
labels, of each at most TRAIN_CHARS characters, whose remainder (crc32 of the id as text, modulo 4) is not HELD_OUT.
Every document is predicted from its whole text; language, source and id are never inputs of a prediction.

Defined cases: a text without a letter (null, empty, or of digits and number signs alone) is ``und`` with score 0, and
only words that hold a letter count; without any labelled row every text is ``und``; ties go to the label that is first
in code-point order; repeated rows, and rows that share an id, are predicted row by row; a very long text is one
chain, held in one task with a few dozen bytes per word; a null id is not held out and never trained on; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, steps

TRAIN_DOCS = 2400
HELD_OUT = 2
UNKNOWN = "und"
#: Characters of a training text that are used (a bound on what the driver collects; predictions use whole texts).
TRAIN_CHARS = 20_000
#: Words of a block, and words that one vectorised pass takes at a time.
BLOCK, PASS_WORDS = 512, 1 << 19
HASH_BITS = 18
LEXICON_WORDS = 20_000
LEXICON_SHARE = 0.8
SPAN = (4, 24)
TRAIN_CHAIN, TRAIN_BATCH, TRAIN_STEPS = 48, 128, 160
RATE, DECAY = 0.3, 1e-6

words_of = re.compile(r"[^\W\d_]+").findall


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature slots of all words' n-grams, owner word of each, 64-bit hash of each word)."""
    marked = "".join([f"\x02{w}\x03" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(points))
    slots, owners = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 5):
        m = len(points) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(0x100000001B3) + points[n - 1 :]
        inside = place[:m] + n <= ends[:m]
        slots.append((mix64(rolled[inside] + np.uint64(n)) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        owners.append(owner[:m][inside])
    whole = np.add.reduceat(mix64(points + (place - (ends - sizes[owner])).astype(np.uint64) * np.uint64(0x9E3779B1)), np.cumsum(sizes) - sizes)
    return np.concatenate(slots), np.concatenate(owners), mix64(whole)


@dataclass(frozen=True)
class Field:
    """A fitted field. ``weights``: (slots + lexicon slots, labels); ``steps``: (labels, labels); ``lexicon``: sorted hashes."""

    labels: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray
    lexicon: np.ndarray
    lexicon_label: np.ndarray

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slot, owner) of all features: n-grams, then the word's own lexicon weight, then its dominating label."""
        slots, owners, whole = word_hashes(words)
        extra, who = [((whole >> np.uint64(64 - HASH_BITS)).astype(np.int64))], [np.arange(len(words))]
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            known = np.flatnonzero(self.lexicon[at] == whole)
            extra.append((1 << HASH_BITS) + self.lexicon_label[at[known]])
            who.append(known)
        return np.concatenate([slots, *extra]), np.concatenate([owners, *who])

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, labels) sums of feature weights."""
        slots, owners = self.features(words)
        return np.stack([np.bincount(owners, self.weights[slots, k], minlength=len(words)) for k in range(len(self.labels))], axis=1)


def _normal(x: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def forward_backward(
    scores: np.ndarray, steps_: np.ndarray, lengths: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label marginals (T, chains, labels) of padded chains, with the scaled messages for the pairwise marginals.

    ``enter`` holds the forward message of the word before each chain (zeros where it starts a text), ``leave`` the
    backward message at each chain's last word; without them a chain is a whole text.
    """
    t, chains, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps_ - steps_.max())
    last = lengths - 1
    alpha, beta = np.empty_like(local), np.empty_like(local)
    first = local[0] if enter is None else np.where(enter.any(axis=1, keepdims=True), enter @ move, 1.0) * local[0]
    alpha[0] = _normal(first, 1)
    for i in range(1, t):
        alpha[i] = _normal((alpha[i - 1] @ move) * local[i], 1)
    out = np.ones((chains, labels), dtype=local.dtype) if leave is None else leave
    beta[-1] = out
    for i in range(t - 2, -1, -1):
        beta[i] = np.where((i < last)[:, None], _normal((local[i + 1] * beta[i + 1]) @ move.T, 1), out)
    alive = (np.arange(t)[:, None] < lengths[None, :])[:, :, None]
    return _normal(alpha * beta, 2) * alive, alpha, local * beta


def transfers(scores: np.ndarray, steps_: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(chains, labels, labels) scaled matrices that take a forward message over a chain; ``starts``: chains that start a text."""
    t, chains, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    move = np.exp(steps_ - steps_.max()).astype(np.float64)
    begin = np.where(starts[:, None, None], np.eye(labels)[None], move[None])
    out = begin * local[0][:, None, :]
    for i in range(1, t):
        onward = (out @ move) * local[i][:, None, :]
        onward /= onward.max(axis=(1, 2), keepdims=True)
        out = np.where((i < lengths)[:, None, None], onward, out)
    return out


def edge_messages(matrices: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(enter, leave) of blocks in text order from their transfer matrices."""
    blocks, labels = matrices.shape[:2]
    enter, leave = np.zeros((blocks, labels)), np.ones((blocks, labels))
    for b in range(1, blocks):
        if not starts[b]:
            before = np.ones(labels) if starts[b - 1] else enter[b - 1]
            enter[b] = _normal(before @ matrices[b - 1], 0)
    for b in range(blocks - 1, 0, -1):
        if not starts[b]:
            leave[b - 1] = _normal(matrices[b] @ leave[b], 0)
    return enter, leave


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit a field on (text, label) rows by stochastic gradient steps (AdaGrad) on the chains' log-likelihood."""
    labels = tuple(sorted({label for _, label in texts}))
    if not labels:
        return Field((), np.zeros((0, 0)), np.zeros((0, 0)), np.empty(0, np.uint64), np.empty(0, np.int64))
    place = {label: k for k, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    docs: list[list[np.ndarray]] = [[] for _ in labels]
    vocabulary: dict[str, int] = {}
    counts: list[Counter] = [Counter() for _ in labels]
    for text, label in texts:
        words = words_of(text.lower())
        if words:
            counts[place[label]].update(words)
            docs[place[label]].append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]))
    total = Counter()
    for c in counts:
        total.update(c)
    frequent = [w for w, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS] if n >= 3]
    lexicon = []
    for w in frequent:
        own = [c[w] for c in counts]
        if max(own) >= LEXICON_SHARE * sum(own):
            lexicon.append((w, int(np.argmax(own))))
    hashes = word_hashes([w for w, _ in lexicon])[2] if lexicon else np.empty(0, dtype=np.uint64)
    order = np.argsort(hashes)
    n, k = (1 << HASH_BITS) + len(labels), len(labels)
    field = Field(labels, np.zeros((n, k)), np.zeros((k, k)), hashes[order], np.array([c for _, c in lexicon], dtype=np.int64)[order])
    names = list(vocabulary)
    usable = [i for i in range(k) if docs[i]]
    if not usable:
        return field
    seen, seen_steps = np.full((n, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(TRAIN_STEPS):
        chain = np.zeros((TRAIN_CHAIN, TRAIN_BATCH), dtype=np.int64)
        truth = np.zeros((TRAIN_CHAIN, TRAIN_BATCH), dtype=np.int64)
        for c in range(TRAIN_BATCH):
            at, alone, label = 0, c % 2 == 0, usable[rng.integers(len(usable))]
            while at < TRAIN_CHAIN:
                own = docs[label][rng.integers(len(docs[label]))]
                size = min(TRAIN_CHAIN - at, len(own), TRAIN_CHAIN if alone else int(rng.integers(*SPAN)))
                begin = int(rng.integers(len(own) - size + 1))
                chain[at : at + size, c], truth[at : at + size, c] = own[begin : begin + size], label
                at += size
                if not alone:
                    label = usable[rng.integers(len(usable))]
        types, code = np.unique(chain, return_inverse=True)
        code = code.reshape(chain.shape)
        slots, owners = field.features([names[i] for i in types])
        by_type = np.stack([np.bincount(owners, field.weights[slots, j], minlength=len(types)) for j in range(k)], axis=1)
        marginal, alpha, onward = forward_backward(by_type[code], field.steps, np.full(TRAIN_BATCH, TRAIN_CHAIN))
        gap = np.eye(k)[truth] - marginal
        pulled = np.stack([np.bincount(code.ravel(), gap[:, :, j].ravel(), minlength=len(types)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(slots, pulled[owners, j], minlength=n) for j in range(k)], axis=1) / TRAIN_BATCH
        pair = alpha[:-1, :, :, None] * np.exp(field.steps)[None, None] * onward[1:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        real = np.zeros((k, k))
        np.add.at(real, (truth[:-1].ravel(), truth[1:].ravel()), 1.0)
        gradient_steps = (real - pair.sum(axis=(0, 1))) / TRAIN_BATCH
        seen += gradient**2
        seen_steps += gradient_steps**2
        field.weights[:] += RATE * gradient / np.sqrt(seen) - DECAY * field.weights
        field.steps[:] += RATE * gradient_steps / np.sqrt(seen_steps)
    return field


def _passes(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of about equal length, so many at a time that padded they hold at most PASS_WORDS words."""
    order = np.argsort(lengths, kind="stable")[::-1]
    begin = 0
    while begin < len(order):
        end = begin + max(1, PASS_WORDS // int(lengths[order[begin]]))
        yield order[begin:end]
        begin = end


def expected_words(by_word: np.ndarray, codes: np.ndarray, sizes: np.ndarray, steps_: np.ndarray, block: int = 0) -> np.ndarray:
    """(texts, labels) expected number of words of each label; ``sizes``: words of each text, ``by_word``: scores by code."""
    block = block or BLOCK
    k = by_word.shape[1]
    blocks = -(-sizes // block)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * block
    lengths = np.minimum(np.repeat(np.cumsum(sizes), blocks) - first, block)

    def scores(part: np.ndarray) -> np.ndarray:
        at = np.minimum(first[part][None, :] + np.arange(int(lengths[part].max()))[:, None], len(codes) - 1)
        return by_word[codes[at]]

    enter, leave = np.zeros((len(owner), k), dtype=by_word.dtype), np.ones((len(owner), k), dtype=by_word.dtype)
    several = np.flatnonzero((blocks > 1)[owner])
    if len(several):
        matrices = np.empty((len(several), k, k))
        for part in _passes(lengths[several]):
            own = several[part]
            matrices[part] = transfers(scores(own), steps_, lengths[own], nth[own] == 0)
        enter[several], leave[several] = edge_messages(matrices, nth[several] == 0)
    expected = np.zeros((len(sizes), k))
    for part in _passes(lengths):
        marginal, _, _ = forward_backward(scores(part), steps_, lengths[part], enter[part], leave[part])
        np.add.at(expected, owner[part], marginal.sum(axis=0, dtype=np.float64))
    return expected


def label_texts(field: Field, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, score) of whole texts."""
    k = len(field.labels)
    flat: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = words_of(t.lower()) if t else []
        counts[i] = len(words)
        flat += words
    if not k or not flat:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    coded = pa.array(flat, type=pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    lettered = np.array([w.isalpha() or any(c.isalpha() for c in w) for w in names])
    owner = np.repeat(np.arange(len(texts)), counts)
    spelt = lettered[codes]
    codes, sizes = codes[spelt], np.bincount(owner[spelt], minlength=len(texts)).astype(np.int64)
    if not len(codes):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    expected = expected_words(field.scores(names).astype(np.float32), codes, sizes, field.steps.astype(np.float32))
    best = expected.argmax(axis=1)
    score = expected[np.arange(len(texts)), best] / np.maximum(sizes, 1)
    named = [field.labels[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
    return named, np.clip(np.where(sizes > 0, score, 0.0), 0.0, 1.0)


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """At most ``most`` labelled (text, label) rows, dealt evenly over labels, the same on every run."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # one row per label
    if not sizes:
        return []
    each = max(1, most // len(sizes))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20))
    keep = F.lit(False)
    for label, n in sorted(sizes.items()):
        keep = keep | ((F.col(lang_col) == label) & (draw < int(min(1.0, 1.1 * each / n + 8 / n) * (1 << 20))))
    rows = labelled.where(keep).select(draw.alias("draw"), F.col(id_col), F.substring(F.col(text_col), 1, TRAIN_CHARS), F.col(lang_col)).collect()
    out, taken = [], Counter()
    for _, _, text, label in sorted(rows, key=lambda r: (r[0], r[1])):
        if taken[label] < each:
            taken[label] += 1
            out.append((text, label))
    return out


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    field = fit(training_sample(df, id_col, text_col, lang_col))
    small = Field(field.labels, field.weights.astype(np.float32), field.steps, field.lexicon, field.lexicon_label)
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, 2):
            named, score = label_texts(small, part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(named), pa.array(score)], names=names)

    names = ["doc_id", "held_out", "lang_pred", "score"]
    return arrow_map(picked, run, "doc_id long, held_out boolean, lang_pred string, score double", "langid")
