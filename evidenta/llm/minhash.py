"""MinHash near-deduplication with min-max hashing.

Under each permutation of the shingle hashes both the least and the greatest value are kept: two signature values for
one hash evaluation, unbiased and with less variance than two independent permutations.  Values are banded ROWS at a
time; a pair at the threshold misses every band with a probability below 1e-8 (0.85) or 1e-5 (0.8).

1. Each text is reduced to its number of distinct shingles, a 128-bit hash of the set, and its band keys.
2. Texts with equal sets form a class, so copies never pair up.
3. Classes that share a band key are bucket mates: these are the candidates, and only they are ever linked.
4. Buckets that share classes form parts.  The classes of a part of at most WHOLE_PART are compared on full shingle sets
   in blocks of at most BLOCK, one task per pair of blocks, so that a class is sent once, not once per bucket.  A task
   returns a spanning forest of its confirmed links, never its pairs.
5. In a larger part every class is first compared with the first class of each of its buckets: work in proportion to
   the buckets' rows, which contracts a group of near copies to one label.  Then bucket mates of different labels are
   compared bucket by bucket, and blocks of one label never meet.
6. Components of the confirmed links give the result.  A link needs a common band key whatever the part's size.

Defined cases: a text without words (or a null or empty one) has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; rows that share an id are rows of their own, each with its text's set, and
equal rows get equal results; null ids are not linked; a very long text is one set, held in one task (8 bytes per
shingle); ties do not occur (a component is named by its smallest id); an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import (
    WORD_RE, arrow_map, candidate_filter, dropped, enter, flat_words, join_counted, marked, may_contain, mix64, prepare, steps, stored,
    text_bytes,
)
from .components import components

#: Classes of a block, members of a hub's block, and classes of a part that is compared at once.
BLOCK, STAR_BLOCK = 128, 512
WHOLE_PART = 4096
#: Bytes of text that are cut into words at a time.
SKETCH_BYTES = 1_500_000
#: Shingles that one pass over the permutations takes: small enough for a core's cache.
PASS_SHINGLES = 1 << 16
#: Columns of a block's incidence matrix that are multiplied at a time.
PASS_COLUMNS = 4096


@dataclass(frozen=True)
class Settings:
    """Shingle width, similarity threshold as a fraction, and the signature's shape."""

    words: int = 5
    over: int = 80
    under: int = 100
    rows: int = 6
    bands: int = 40
    seed: int = 20_240_601

    @property
    def hashes(self) -> int:
        return self.rows * self.bands // 2  # each gives a minimum and a maximum

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        draws = rng.integers(0, 2**64, size=(2, self.hashes), dtype=np.uint64)
        return draws[0] | np.uint64(1), draws[1]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of each text one after another, how many each text has)."""
    import xxhash

    codes, counts, words = flat_words([t.lower() for t in texts])  # bytes.lower() changes A-Z alone
    hashed = mix64(np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64))
    value = hashed[codes] if len(codes) else np.empty(0, dtype=np.uint64)
    n = len(value)
    base = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * base + value[j : n - k + 1 + j] if len(rolled) else rolled
    rolled = mix64(rolled)
    ends = np.cumsum(counts)
    sets, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if count >= k:
            own = np.unique(rolled[end - count : end - k + 1])
        elif count:
            short = np.uint64(count)
            for v in value[end - count : end]:
                short = _join(short, v, base)
            own = mix64(np.array([short], dtype=np.uint64))
        else:
            continue
        sizes[i] = len(own)
        sets.append(own)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)), sizes


def _join(a: np.uint64, b: np.uint64, base: np.uint64) -> np.uint64:
    return np.uint64((int(a) * int(base) + int(b)) % 2**64)


def signatures(shingles: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(texts with shingles, 2 * permutations) least and greatest values; ``sizes`` has no zero."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty((len(sizes), 2 * len(a)), dtype=np.uint64)
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + PASS_SHINGLES, side="right")) - 1)
        part = shingles[starts[begin] : starts[end]]
        at = starts[begin:end] - starts[begin]
        buffer = np.empty_like(part)
        for i in range(len(a)):
            np.multiply(part, a[i], out=buffer)
            np.add(buffer, b[i], out=buffer)
            out[begin:end, 2 * i] = np.minimum.reduceat(buffer, at)
            out[begin:end, 2 * i + 1] = np.maximum.reduceat(buffer, at)
        begin = end
    return out


def band_keys(signed: np.ndarray, s: Settings) -> np.ndarray:
    """(texts, bands) 64-bit keys.  A band takes values of different permutations, so no band holds a pair of one."""
    keys = np.empty((len(signed), s.bands), dtype=np.uint64)
    half = np.concatenate([signed[:, 0::2], signed[:, 1::2]], axis=1)  # all minima, then all maxima
    for band in range(s.bands):
        key = np.full(len(signed), band + 1, dtype=np.uint64)
        for j in range(s.rows):
            key = mix64(key * np.uint64(31) + half[:, band * s.rows + j])
        keys[:, band] = key
    return keys


def sketch(df: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, n, set_a, set_b, bands) of every row, in one pass without a shuffle; ``tie`` is a hash of the text."""
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = s.permutations()
        for part in steps(batches, 1, SKETCH_BYTES):
            shingles, sizes = shingle_sets(text_bytes(part.column(1)), s.words)
            full = np.flatnonzero(sizes)
            set_a, set_b = set_hashes(shingles, sizes)
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            keys = np.empty(0, dtype=np.uint64)
            if len(full):
                keys = band_keys(signatures(shingles, sizes[full], a, b), s).ravel()
            offsets[1:] = np.cumsum((sizes > 0) * s.bands)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(sizes), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))),
                ],
                names=["id", "tie", "n", "set_a", "set_b", "bands"],
            )

    return arrow_map(picked, run, "id long, tie long, n long, set_a long, set_b long, bands array<long>", "minhash")


def set_hashes(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set (0 for an empty one)."""
    full = np.flatnonzero(sizes)
    out = np.zeros((2, len(sizes)), dtype=np.uint64)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
        out[0, full] = np.add.reduceat(mix64(shingles + np.uint64(1)), starts)
        out[1, full] = np.add.reduceat(mix64(shingles ^ np.uint64(0x5BF03635)), starts)
    return out[0], out[1]


def full_sets(df: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles array<long>) of every row; a node is the first hash of a set."""
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, 1, SKETCH_BYTES):
            shingles, sizes = shingle_sets(text_bytes(part.column(1)), s.words)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            nodes = set_hashes(shingles, sizes)[0].view(np.int64)
            arrays = [pa.array(nodes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "shingles"])

    return arrow_map(picked, run, "node long, shingles array<long>", "minhash")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    ends, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    return [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, sets) sizes of the intersections."""
    m = len(sets)
    flat = np.concatenate(sets) if m else np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    both = np.zeros((m, m), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, width, PASS_COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + PASS_COLUMNS])
        block = np.zeros((m, PASS_COLUMNS), dtype=np.float32)
        block[owner[low:high], column[low:high] - begin] = 1.0
        both += (block @ block.T).astype(np.int64)  # counts below 2**24 are exact in float32
    return both


def spanning_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], s: Settings) -> list[tuple[int, int]]:
    """Links of a spanning forest over the labels, of bucket mates with under * intersection >= over * union."""
    both = common_counts(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    left, right = np.nonzero(np.triu((s.under * both >= s.over * union) & (labels[:, None] != labels[None, :]), 1))
    parent = {x: x for x in labels.tolist()}
    keys: dict[int, np.ndarray] = {}
    a, b = s.permutations()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def bands(i: int) -> np.ndarray:
        if i not in keys:
            keys[i] = band_keys(signatures(sets[i].view(np.uint64), sizes[i : i + 1], a, b), s)[0]
        return keys[i]

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y and (bands(i) == bands(j)).any():
            parent[max(x, y)] = min(x, y)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def _compared(sent: DataFrame, sets: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """Confirmed links (a, b) between the different labels of rows (node, label, keys), one task per value of the keys."""

    def compare(found: pa.Table) -> pa.Table:
        enter("minhash")
        nodes, labels = found.column("node").to_numpy(), found.column("label").to_numpy()
        return _links(spanning_links(nodes, labels, _lists(found.column("shingles")), s))

    prepare(sent.sparkSession)
    return sent.join(sets, "node").groupBy(*keys).applyInArrow(compare, "a long, b long")


def part_links(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links (a, b) of members (node, part) of small parts, block against block."""
    sizes = members.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = members.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = paired.select("node", F.col("node").alias("label"), "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return _compared(sent, sets, ["part", "i", "j"], s)


def star_links(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links (a, b) of distinct pairs (node, hub).  A hub's members are dealt to blocks, and the hub goes to each."""
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR_BLOCK)).cast("int").alias("blocks"))
    members = pairs.join(hubs, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    centres = hubs.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compare(found: pa.Table) -> pa.Table:
        enter("minhash")
        nodes, sets_ = found.column("node").to_numpy(), _lists(found.column("shingles"))
        hub = found.column("hub")[0].as_py()
        centre = next((x for n, x in zip(nodes.tolist(), sets_, strict=True) if n == hub), None)
        if centre is None:
            return _links([])
        out = []
        for n, own in zip(nodes.tolist(), sets_, strict=True):
            both = len(np.intersect1d(own, centre, assume_unique=True)) if n != hub else 0
            if n != hub and s.under * both >= s.over * (len(own) + len(centre) - both):
                out.append((n, hub))
        return _links(out)

    prepare(pairs.sparkSession)
    return members.unionByName(centres).join(sets, "node").groupBy("hub", "block").applyInArrow(compare, "a long, b long")


def star_labels(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links (a: node, b: hub): the smallest hub of a node's smallest hub, or that hub.

    Nodes of one label are connected; nodes of one component may have several labels, which costs only comparisons.
    """
    nearest = links.groupBy("a").agg(F.min("b").alias("hub")).select(F.col("a").alias("node"), F.least("a", "hub").alias("hub"))
    onward = nearest.select(F.col("node").alias("via"), F.col("hub").alias("label"))
    return nearest.join(onward, F.col("hub") == F.col("via"), "left").select("node", F.coalesce("label", "hub").alias("label"))


def bucket_links(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links (a, b) between different labels of members (node, key, label), bucket by bucket in blocks.

    A label with at least BLOCK members of a bucket has blocks of its own (numbered, with ``pure`` its label), the
    others share blocks; two blocks of one label never meet.
    """
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    pure = F.when(F.col("size") >= BLOCK, F.col("label"))
    shared = sizes.where(F.col("size") < BLOCK).groupBy("key").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).alias("shared"))
    cut = sizes.join(shared, "key", "left").select(
        "key", "label", pure.alias("pure"), F.coalesce(F.when(pure.isNotNull(), F.ceil(F.col("size") / F.lit(BLOCK))), "shared").alias("blocks")
    )
    hashed = F.when(F.col("pure").isNotNull(), F.xxhash64("node")).otherwise(F.xxhash64("label"))
    placed = stored(
        members.join(cut, ["key", "label"]).select("node", "key", "label", "pure", F.pmod(hashed, F.col("blocks")).alias("nth")), "blocks"
    )
    blocks = placed.select("key", "pure", "nth").distinct().withColumn("block", F.xxhash64("pure", "nth"))
    a, b = (blocks.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("pure", "nth", "block")]) for side in ("a", "b"))
    mixed = a.where("pure_a is null").join(b, "key").where("pure_b is not null or nth_a <= nth_b")
    apart = a.where("pure_a is not null").join(b.where("pure_b is not null"), "key").where("pure_a < pure_b")
    tasks = mixed.unionByName(apart).select("key", F.col("block_a").alias("x"), F.col("block_b").alias("y"))
    sides = tasks.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    sent = placed.withColumn("block", F.xxhash64("pure", "nth")).join(sides, ["key", "block"]).select("node", "label", "key", "x", "y")
    return _compared(sent, sets, ["key", "x", "y"], s)


def large_part_links(hits: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links (a, b) of the bucket mates of large parts: stars first, then what the stars leave open."""
    pairs = hits.where("node <> first").select("node", F.col("first").alias("hub")).distinct()
    star = stored(star_links(pairs, sets, s), "star-links")
    labels = stored(star_labels(star), "labels")
    told = stored(hits.join(labels, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label")), "labelled")
    several = told.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    open_ = told.join(several, "key", "left_semi")
    return star.unionByName(bucket_links(open_, sets, s))


def class_rows(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, bands) of the rows that stand for their class, stored.

    Rows whose class has no copies, nearly all, are told by a bitmap, so that their bands are not shuffled.
    """
    doubled = stored(classes.where("copies > 1").select("set_a"), "doubled")
    told = marked(known, "set_a", candidate_filter(doubled, "set_a"), "may_repeat")
    same = classes.select(F.col("class").alias("own_id"), F.col("set_a").alias("own_a"), F.col("set_b").alias("own_b"))
    own = (F.col("id") == F.col("own_id")) & (F.col("set_a") == F.col("own_a")) & (F.col("set_b") == F.col("own_b"))
    lone = told.where("not may_repeat").unionByName(told.where("may_repeat").join(same, own, "left_semi"))
    out = stored(lone.select(F.col("set_a").alias("node"), "bands"), "lone")
    dropped(doubled)
    return out


def candidate_hits(lone: DataFrame) -> DataFrame:
    """(node, key, first) of every class in a bucket of two or more, stored; ``first`` is the bucket's smallest node."""
    banded = lone.select("node", F.explode("bands").alias("key"))
    buckets = stored(
        banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first"), "buckets"
    )
    out = stored(may_contain(banded, "key", candidate_filter(buckets, "key")).join(buckets, "key").select("node", "key", "first"), "hits")
    dropped(buckets)
    return out


def near_duplicates(df: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, n, component, least_node) of every row of ``df``; a component is the smallest id that confirmed links reach.

    Where rows share an id two components can have one name; ``least_node`` tells them apart (null for an empty set or
    a null id).
    """
    sketches = stored(sketch(df, s, id_col, text_col), "sketches")
    rows = stored(sketches.drop("bands"), "rows")
    known = rows.where("n > 0 and id is not null")
    classes = stored(
        known.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    lone = class_rows(sketches.where("n > 0 and id is not null"), classes)
    dropped(sketches)
    hits = candidate_hits(lone)
    dropped(lone)
    parts = stored(components(hits.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))), "parts")
    named = classes.select(F.col("class").alias("id"), F.col("set_a").alias("node"))
    wanted = stored(named.join(parts.select("node"), "node", "left_semi").select(F.xxhash64("id").alias("h")), "wanted")
    near = df.select(F.col(id_col).cast("long").alias("cand_id"), F.col(text_col).alias("cand_text"))
    found = full_sets(may_contain(near.withColumn("h", F.xxhash64("cand_id")), "h", candidate_filter(wanted, "h")), s, "cand_id", "cand_text")
    sets = stored(found.join(parts.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.where(F.col("size") > WHOLE_PART).select("component"), "large-parts")
    members = parts.select("node", F.col("component").alias("part"))
    if large.count():
        of_large = parts.join(large, "component", "left_semi").select("node")
        links = large_part_links(hits.join(of_large, "node", "left_semi"), sets, s)
        members = members.join(large, F.col("part") == F.col("component"), "left_anti")
        links = links.unionByName(part_links(members, sets, s))
    else:
        links = part_links(members, sets, s)
    confirmed = stored(links, "confirmed")
    dropped(hits, sets, parts, wanted, large)
    joined = stored(components(confirmed), "joined")
    named = joined.join(classes.select(F.col("set_a").alias("node"), "class"), "node")
    least = named.groupBy("component").agg(F.min("class").alias("named"), F.count(F.lit(1)).alias("members"))
    by_node = join_counted(joined, least, ["component"], "members", joined.count()).groupBy("node").agg(
        F.min("named").alias("named"), F.min("component").alias("least_node")
    )
    labelled = classes.join(by_node, F.col("set_a") == F.col("node"), "left").select(
        "set_a", "set_b", "n", "copies", F.coalesce("named", "class").alias("component"), F.coalesce("least_node", "set_a").alias("least_node")
    )
    labelled = stored(labelled, "labelled-classes")
    some = known.select("id", "tie", "n", "set_a", "set_b")
    columns = ["id", "tie", "n", "component", "least_node"]
    out = join_counted(some, labelled, ["set_a", "set_b", "n"], "copies", some.count()).select(*columns)
    alone = rows.where("n = 0 or id is null").select("id", "tie", "n", F.col("id").alias("component"), F.lit(None).cast("long").alias("least_node"))
    return out.unionByName(alone)


def keep_one(df: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the document that names it stays, once.

    Rows are told apart by id and text, so a row goes only for its own text; of rows that share the component's id the
    one with the smallest text hash stays.  Rows with an empty set or a null id stay.  Texts are shuffled only for rows
    that may go and for rows that share their id.
    """
    found = stored(near_duplicates(df, s, id_col, text_col), "near")
    some = found.where("n > 0 and id is not null")
    keys = F.xxhash64("id", "tie").alias("row_hash")
    shared = stored(some.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("shared_id")), "shared-ids")
    heads = some.where("id = component").join(shared, F.col("id") == F.col("shared_id"), "left_semi")
    least = heads.groupBy("least_node").agg(F.min("tie").alias("least"))
    doubled = heads.join(least, "least_node").where("tie > least").select("id", "tie")
    gone = stored(some.where("id <> component").select("id", "tie").unionByName(doubled).distinct().withColumn("row_hash", keys), "gone")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    own = whole.select("row", F.col("row")[id_col].cast("long").alias("own_id"), F.xxhash64(F.col("row")[text_col]).alias("own_tie"))
    hashed = own.withColumn("own_hash", F.xxhash64("own_id", "own_tie"))
    maybe = marked(hashed, "own_hash", candidate_filter(gone, "row_hash"), "may_go")
    same = (F.col("own_id") == F.col("id")) & (F.col("own_tie") == F.col("tie"))
    stays = maybe.where("not may_go").unionByName(maybe.where("may_go").join(gone.select("id", "tie"), same, "left_anti")).drop("may_go")
    shared = shared.withColumn("id_hash", F.xxhash64("shared_id"))
    twice = marked(stays.withColumn("own_id_hash", F.xxhash64("own_id")), "own_id_hash", candidate_filter(shared, "id_hash"), "may_repeat")
    twice = twice.withColumn("may_repeat", F.col("may_repeat") & F.col("own_id").isNotNull() & F.coalesce(F.col("row")[text_col].rlike(WORD_RE), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("own_id", "own_tie").orderBy(F.xxhash64("row")))
    once = twice.where("may_repeat").withColumn("nth", nth).where("nth = 1").drop("nth")
    return twice.where("not may_repeat").unionByName(once).select(*[F.col("row")[c].alias(c) for c in df.columns])
