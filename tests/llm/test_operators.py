import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenta.llm import bpe, exactdedup, langid, linededup, minhash, mixing, quality, secrets, sharding, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return WORD.findall(text or "")


# 1. sharding


def test_sharding_law_slots_and_checksums(docs, rows):
    out = by_id(sharding.shard_documents(docs, 8))
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        raw = (text or "").encode()
        r = out[i]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    slots = defaultdict(list)
    for r in out.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_even_and_grows_by_a_ninth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.build_tree(8)
    now = sharding.assign_shards(ids, tree).withColumnRenamed("shard", "a")
    both = sharding.assign_shards(now, sharding.grow(tree, 8)).collect()
    sizes = Counter(r["a"] for r in both)
    assert all(abs(n - 2500) < 250 for n in sizes.values())
    moved = [r for r in both if r["a"] != r["shard"]]
    assert {r["shard"] for r in moved} == {8}
    assert abs(len(moved) - 20_000 / 9) < 250
    weighted = sharding.assign_shards(ids, sharding.build_tree(8, weights={3: 3.0})).groupBy("shard").count().collect()
    counts = {r["shard"]: r["count"] for r in weighted}
    assert abs(counts[3] - 6000) < 400


def brute_draw(key, name, weight):
    u = (int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight


def brute_shard(key, leaves, grown=None):
    """The shard of a key in a tree of {region: {rack: {shard: weight}}}; ``grown``: (region, rack, shard, weight)."""

    def least(options):
        return min((brute_draw(key, name, w), i) for i, (name, w, _) in enumerate(options))[1]

    regions = [(f"region{g}", sum(sum(x.values()) for x in racks.values()), racks) for g, racks in leaves.items()]
    if grown:
        g, r, new, weight = grown
        at = list(leaves).index(g) + 1
        regions.insert(at, (f"region{g}+{new}", weight, None))
    racks = regions[least(regions)][2]
    if racks is None:
        return new
    g = next(k for k, v in leaves.items() if v is racks)
    options = [(f"rack{g}.{r}", sum(x.values()), x) for r, x in racks.items()]
    shards = options[least(options)][2]
    options = [(f"shard{s}", w, s) for s, w in shards.items()]
    return options[least(options)][2]


def leaves_of(shards, weights=None):
    out = {}
    for s in range(shards):
        out.setdefault(s % 2, {}).setdefault(s // 2 % 2, {})[s] = (weights or {}).get(s, 1.0)
    return out


def test_sharding_equals_a_descent_by_hand(docs):
    out = by_id(sharding.shard_documents(docs, 8))
    for i, r in out.items():
        assert r["shard"] == brute_shard(i, leaves_of(8))
        assert r["grown_shard"] == brute_shard(i, leaves_of(8), (0, 0, 8, 1.0))


def test_a_grown_tree_holds_the_new_shard_in_its_region_and_rack():
    grown = sharding.grow(sharding.grow(sharding.build_tree(8), 8), 9)
    region = next(c for c in grown.children if c.name == "region0")
    rack = next(c for c in region.children if c.name == "rack0.0")
    assert [c.shard for c in rack.children] == [0, 4, 8] and (grown.weight, region.weight, rack.weight) == (10, 5, 3)
    assert [c.shard for c in grown.children[1].children[0].children] == [1, 5, 9]


def test_growing_twice_takes_rows_only_into_the_last_shard(spark):
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    one = sharding.grow(sharding.build_tree(8), 8)
    now = sharding.assign_shards(ids, one).withColumnRenamed("shard", "a")
    both = sharding.assign_shards(now, sharding.grow(one, 9)).collect()
    assert {r["shard"] for r in both if r["a"] != r["shard"]} == {9}
    sizes = Counter(r["shard"] for r in both)
    assert all(abs(n - 3000) < 300 for n in sizes.values()) and len(sizes) == 10


def test_a_changed_weight_moves_rows_only_into_its_subtree(spark):
    """Shard 3 stands in region 1, rack 1.1; a greater weight draws rows towards it on every level and moves no other."""
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    now = sharding.assign_shards(ids, sharding.build_tree(8)).withColumnRenamed("shard", "a")
    moved = [(r["a"], r["shard"]) for r in sharding.assign_shards(now, sharding.build_tree(8, weights={3: 2.0})).collect() if r["a"] != r["shard"]]
    region, rack = (lambda s: s % 2), (lambda s: (s % 2, s // 2 % 2))
    assert moved
    for a, b in moved:
        if region(a) != region(b):
            assert region(b) == region(3)
        elif rack(a) != rack(b):
            assert rack(b) == rack(3)
        else:
            assert b == 3


def test_sharding_repeated_rows_and_empty(docs, empty):
    twice = docs.union(docs)
    out = sharding.shard_documents(twice, 3).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


# 2. mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in free)
        t = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing_matches_iterated_targets(docs, rows):
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    expected, out = targets(sizes), by_id(mixing.mix(docs))
    taken = Counter()
    for i, t, _, s, *_ in rows:
        r = out[i]
        assert r["size"] == len(words(t)) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert {i: r["taken"] for i, r in by_id(mixing.mix(docs.repartition(7))).items()} == {i: r["taken"] for i, r in out.items()}


def test_mixed_rows_hold_the_taken_words(docs, rows, empty):
    taken = {i: r["taken"] for i, r in by_id(mixing.mix(docs)).items()}
    got = Counter()
    whole = {i: t for i, t, *_ in rows}
    for r in mixing.mixed_rows(docs).collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["text"] == whole[r["doc_id"]] or whole[r["doc_id"]].startswith(r["text"])
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


# 3. language


def test_language_of_code_switched_words():
    rng = np.random.default_rng(0)
    en, fr = ["the", "house", "with", "thing", "other", "ring"], ["le", "maison", "avec", "chose", "autre", "eau"]
    make = lambda w: " ".join(rng.choice(w, 60))
    field = langid.fit([(make(w), label) for _ in range(30) for w, label in ((en, "en"), (fr, "fr"))])
    named, score = langid.label_texts(field, [make(en), make(fr), None, "123 !!", "²", make(en) + " " + " ".join(fr)])
    assert named == ["en", "fr", "und", "und", "und", "en"]
    assert score[0] > 0.95 and score[2] == 0 and 0.8 < score[5] < 0.97
    assert field.steps[0, 0] > field.steps[0, 1]


@pytest.mark.parametrize("block", [0, 2, 3])
def test_marginals_equal_the_enumeration_of_all_paths(block):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        scores, steps = rng.normal(size=(n, 3)) * 2, rng.normal(size=(3, 3))
        mass = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = math.exp(sum(scores[i, p] for i, p in enumerate(path)) + sum(steps[a, b] for a, b in itertools.pairwise(path)))
            for i, p in enumerate(path):
                mass[i, p] += w
        mass /= mass.sum(axis=1, keepdims=True)
        got = langid.expected_words(scores, np.arange(n), np.array([n]), steps, block)
        assert np.allclose(got, mass.sum(axis=0))
        twice = langid.expected_words(scores, np.tile(np.arange(n), 2), np.array([n, 0, n]), steps, block)
        assert np.allclose(twice[[0, 2]], got) and not twice[1].any()


@pytest.mark.parametrize("n", range(1, 11))
def test_texts_without_a_letter_are_undetermined(n):
    field = langid.fit([("the house with thing " * 20, "en"), ("le maison avec chose " * 20, "fr")])
    for sign in ("²", "½", "①", "7", "_", "٣"):
        named, score = langid.label_texts(field, [" ".join([sign] * n), " ".join([sign] * n) + " house"])
        assert named == ["und", "en"] and score[0] == 0


def test_held_out_accuracy(spark):
    """Invented prose in three languages of shared letters; a quarter of the labelled rows is held out."""
    rng = np.random.default_rng(5)
    stems = {"aa": ["the", "and", "ing", "ou", "ther"], "bb": ["le", "eau", "tion", "ou", "ent"], "cc": ["der", "sch", "ung", "tion", "ent"]}
    rows = []
    for i in range(600):
        lang = ("aa", "bb", "cc")[i % 3]
        made = [rng.choice(stems[lang], rng.integers(1, 3)) for _ in range(int(rng.integers(15, 80)))]
        rows.append((i, " ".join("".join(x) for x in made), lang))
    out = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    held = [r for r in rows if out[r[0]]["held_out"]]
    assert len(held) > 100 and sum(out[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)


def test_language_query_shape_and_no_labels(spark, docs, empty, rows):
    out = by_id(langid.identify(docs))
    assert len(out) == len(rows)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
    assert out[0]["lang_pred"] == "und"
    assert langid.identify(empty).count() == 0
    none = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}


# 4. BPE


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out, ids = by_id(bpe.round_trip_digests(docs, path)), by_id(bpe.encode_texts(docs, path))
    decoded = by_id(bpe.decode_ids(bpe.encode_texts(docs, path), path))
    for i, text, *_ in rows:
        e = library.encode(text or "", add_special_tokens=False).ids
        d = library.decode(e, skip_special_tokens=False)
        assert ids[i]["ids"] == e and decoded[i]["decoded"] == d
        r = out[i]
        assert r["n_tokens"] == len(e)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d.encode()).hexdigest()
    assert bpe.round_trip_digests(empty, path).count() == 0


def test_forced_cuts_are_never_inside_a_token():
    c = bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    body = [t.removesuffix(c.suffix) for t in c.tokens.values() if t not in c.specials]
    assert all(c.cuts(t) == [t] for t in body[::50] if t)
    assert sum(len(c.cuts(x)) for x in ("qzxj", "zzqqxx", "jqvx")) > 3


# 5. secrets


def brute_base(text):
    found = []
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if kind == "assign" else 0):
            ok = len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)
            if ok:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(found)]


def test_secret_base_spans(docs, rows, empty):
    for r in secrets.find_secrets(docs).collect():
        text = rows[r["doc_id"]][1] or ""
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "bare"]
        assert base == brute_base(text)
    assert secrets.find_secrets(empty).count() == 0


def test_copied_values_are_not_owned(spark):
    live, copied = "Zk3vQ9xT7mB2nR8pL5wD1", "Qw8eRt6yUi4oPa2sDf9gH"
    rows = [(1, f"see {live} there", "a"), (2, f"see {copied}", "a"), (3, f"see {copied}", "b"), (4, None, None), (4, None, None)]
    out = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(s["kind"], s["start"], s["end"], s["owned"]) for s in out[1]] == [("bare", 4, 25, True)]
    assert out[2] == out[3] == out[4] == []


def brute_live(rows):
    """(row, start, end) of bare tokens of one owner in few repositories, compared pair by pair."""
    found, repos, owners = [], defaultdict(set), defaultdict(set)
    for n, (i, text, owner) in enumerate(rows):
        base = [x.split(":") for x in brute_base(text or "")]
        values = [(int(s), int(e), False) for _, s, e in base]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            if secrets.looks_live(m[0]):
                if all(e <= m.start() or m.end() <= s for s, e, _ in values if not _):
                    found.append((n, m.start(), m.end(), m[0]))
        for kind, s, e in base:
            value = text[int(s) : int(e)]
            if kind == "assign":
                value = re.match(secrets.ASSIGN.pattern, value, re.IGNORECASE | re.ASCII)[2]
            repos[value].add(i), owners[value].add(owner)
    for n, _, _, value in found:
        repos[value].add(rows[n][0]), owners[value].add(rows[n][2])
    return {(n, s, e) for n, s, e, v in found if len(owners[v]) < secrets.COPIED_OWNERS and len(repos[v]) < secrets.COPIED_REPOS}


def test_live_spans_equal_brute_force(spark):
    """Tokens of one or two owners, in few or many repositories, in and beside base spans, in rows that share ids."""
    rng = np.random.default_rng(9)
    letters = list("ABCDEFGHJKMNPQRSTUVWXYZbcdefghkmnpqrstuvwyz23456789")
    tokens = ["".join(rng.choice(letters, 24)) for _ in range(12)]
    rows = []
    for i in range(60):
        picked = [tokens[k] for k in rng.integers(0, 12, 3)] if i % 2 else [tokens[0], tokens[1 + i % 3]]
        text = " and ".join(picked) + (f" token={tokens[3 + i % 4]} end" if i % 5 == 0 else "")
        rows.append((i // 2, text, None if i % 7 == 0 else "ab"[int(tokens.index(picked[0]) % 3 == 0) * (i % 2)]))
    rows += [(100 + i, f"only here {tokens[11][::-1]} again", "a") for i in range(secrets.COPIED_REPOS)]
    rows += [(200 + i, f"few {tokens[10][::-1]} copies", "a") for i in range(secrets.COPIED_REPOS - 1)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, n int").coalesce(1)
    got = secrets.find_secrets(df).collect()
    live = Counter((r["doc_id"], r["owner"], s["start"], s["end"]) for r in got for s in r["spans"] if s["kind"] == "bare")
    expected = Counter((rows[n][0], rows[n][2], s, e) for n, s, e in brute_live(rows))
    assert live == expected and any(i >= 200 for i, *_ in live) and not any(100 <= i < 200 for i, *_ in live)


def test_spans_of_a_long_text_are_found_in_linear_time():
    text = " ".join(f"token={i:09d}x Zk3vQ9xT7mB2nR8pL{i:06d}" for i in range(40_000))
    begin = time.process_time()
    found = secrets.candidates(text)
    assert len(found) == 80_000 and time.process_time() - begin < 20


# 6. MinHash


def brute_components(texts, k, over, under=100):
    def shingles(t):
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(t)]
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if under * both >= over * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "over"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(docs, rows, k, over):
    out = by_id(minhash.near_duplicates(docs, minhash.Settings(words=k, over=over)), "id")
    assert {i: (r["n"], r["component"]) for i, r in out.items()} == brute_components({r[0]: r[1] for r in rows}, k, over)


def test_minhash_blocks_parts_and_hubs(spark, monkeypatch, empty):
    """Small blocks, parts compared at once or bucket by bucket: the same links."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR_BLOCK", 3)
    base = [f"v{i}" for i in range(200)]
    texts = {i: " ".join(base[: 200 - i % 23] + [f"t{i}"] * (i % 5)) for i in range(40)}
    texts |= {100 + i: " ".join(base[:60] + [f"x{i % 9}y{j}" for j in range(5 + i % 9)]) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_components(texts, 3, 85)
    for whole in (4096, 5):
        monkeypatch.setattr(minhash, "WHOLE_PART", whole)
        out = by_id(minhash.near_duplicates(df, minhash.Settings(words=3, over=85)), "id")
        assert {i: (r["n"], r["component"]) for i, r in out.items()} == expected
    assert minhash.near_duplicates(empty, minhash.Settings()).count() == 0


def test_links_that_no_bucket_head_confirms_are_found(monkeypatch):
    """A chain a - b - c whose ends are unlike, mates of one label that need no comparison, and no mates at all."""
    sets = [np.arange(0, 100), np.arange(8, 108), np.arange(16, 116), np.arange(500, 600)]
    nodes, s = np.array([10, 11, 12, 13]), minhash.Settings(words=3, over=85)
    assert minhash.spanning_links(nodes, nodes, sets, s) == [(10, 11), (11, 12)]
    assert minhash.spanning_links(nodes, np.array([10, 10, 12, 13]), sets, s) == [(11, 12)]
    fresh = itertools.count()
    monkeypatch.setattr(minhash, "band_keys", lambda signed, s: np.array([[next(fresh)]]))
    assert minhash.spanning_links(nodes, nodes, sets, s) == []


def test_signatures_hold_the_least_and_greatest_value_of_each_permutation():
    s = minhash.Settings(rows=2, bands=4)
    a, b = s.permutations()
    shingles, sizes = minhash.shingle_sets([b"a b c d e f", b"x y z"], 3)
    got = minhash.signatures(shingles, sizes, a, b)
    for t, own in enumerate((shingles[:4], shingles[4:])):
        for i in range(s.hashes):
            values = [(int(x) * int(a[i]) + int(b[i])) % 2**64 for x in own]
            assert (got[t, 2 * i], got[t, 2 * i + 1]) == (min(values), max(values))


def test_keep_one_keeps_rows_for_their_own_text(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    a, b, c = " ".join(base), " ".join(near), " ".join(f"z{i}" for i in range(40))
    rows = [(1, a, "x"), (2, b, "x"), (2, c, "x"), (3, a, "x"), (4, c, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x"), (None, a, "x"), (7, "q r s t u v", "x"), (7, "q r s t u v", "x")]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"), minhash.Settings()).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(1, a), (2, c), (5, ""), (5, ""), (6, None), (None, a), (7, "q r s t u v")])


# 7. exact dedup


def test_exact_dedup_equals_brute_force(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = by_id(exactdedup.equal_groups(docs), "id")
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = out[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["sha"]) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert len(out) == len(rows) and exactdedup.equal_groups(empty).count() == 0


def test_directory_doubles_overfull_buckets_and_chains_hot_keys(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) as key").union(spark.range(400).selectExpr("5L as key"))
    start = exactdedup.first_depth(3400, 50)
    bits = start + exactdedup.DOUBLINGS
    slots = exactdedup.directory(keys, 50, start).collect()
    assert len(slots) == len({r["slot"] for r in slots}) and len({r["depth"] for r in slots}) > 1
    lookup = {r["slot"]: r for r in slots}
    sizes, deep = Counter(), 0
    for r in keys.select(exactdedup.slot(keys["key"], bits).alias("s")).collect():
        sizes[lookup[r["s"]]["bucket"]] += 1
    for r in slots:
        assert r["load"] == sizes[r["bucket"]] and r["pages"] == -(-r["load"] // 50)
        assert r["bucket"] >> (bits - r["depth"]) == r["slot"] >> (bits - r["depth"])
        if r["depth"] > start:  # one bit less would not have done
            half = r["slot"] >> (bits - r["depth"] + 1)
            deep += 1
            assert sum(n for s, n in Counter(exactdedup_slot(keys, bits)).items() if s >> (bits - r["depth"] + 1) == half) > 50 if deep < 3 else True
    hot = next(r for r in slots if r["slot"] == 0)
    assert hot["pages"] >= 8 and hot["depth"] == bits


def exactdedup_slot(keys, bits):
    return [r["s"] for r in keys.select(exactdedup.slot(keys["key"], bits).alias("s")).collect()]


def test_owners_compare_texts_of_one_key_by_their_bytes(docs, rows, monkeypatch):
    """All texts under one of two keys, pages of three entries: chains alone tell texts apart."""
    expected = {i: tuple(r) for i, r in by_id(exactdedup.equal_groups(docs), "id").items()}
    monkeypatch.setattr(exactdedup, "key_of", lambda norm: F.length(norm).cast("long") % 2)
    assert {i: tuple(r) for i, r in by_id(exactdedup.equal_groups(docs, page_entries=3), "id").items()} == expected


def test_without_its_directory_the_index_finds_no_group(docs, monkeypatch):
    """The directory decides which task compares which texts; texts whose slot it lacks meet nobody."""
    monkeypatch.setattr(exactdedup, "directory", lambda *_: real(*_).where("slot < 0"))
    assert {r["group_size"] for r in exactdedup.equal_groups(docs).collect()} == {1}


real = exactdedup.directory


# 8. wavelet matrix


def test_wavelet_round_trip_equals_the_library(docs, rows, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, start = Tokenizer.from_file(path), 0
    out = by_id(wavelet.round_trip(docs, path))
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = out[i]
        assert r["n_end_ids"] == ids.count(2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
def test_wavelet_access_count_select(n):
    tokens = np.random.default_rng(n).integers(0, 37, n).astype(np.uint32) * 1000
    data = wavelet.WaveletMatrix.build(tokens).to_bytes(np.array([5]), np.array([True]), np.array([n]))
    m, ids, valid, lengths = wavelet.WaveletMatrix.from_bytes(data)
    assert (m.decode() == tokens).all() and (m.access(np.arange(n)) == tokens).all()
    for t in np.unique(tokens)[:5]:
        assert m.count(int(t)) == (tokens == t).sum() and (m.select(int(t)) == np.flatnonzero(tokens == t)).all()
        assert m.count(int(t), n // 3, n // 2) == (tokens[n // 3 : n // 2] == t).sum()
        places = np.array([0, n // 3, n // 2, n])
        assert m.rank(int(t), places).tolist() == [(tokens[:p] == t).sum() for p in places]
    assert m.rank(17, np.array([0, n])).tolist() == [0, 0]
    assert m.count(17) == 0 and list(ids) == [5] and list(lengths) == [n]


def test_a_broken_file_is_noticed(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = wavelet.write_shards(docs.limit(3), "/nowhere" and path, 2)
    with pytest.raises(Exception, match="broken"):
        wavelet.read_documents(shards, 3).collect()


# 9. line dedup


def brute_lines(text):
    """Soft lines by hand: a word ends one at a line feed, after punctuation and a space, or as the eighth."""
    out, now, count = [], "", 0
    for word in re.findall(r"[^ \n]*[ \n]|[^ \n]+$", text):
        now, count = now + word, count + 1
        if word[-1] == "\n" or count == 8 or (word[-1] == " " and word[-2:-1] in tuple(".,;:!?")):
            out.append(now)
            now, count = "", 0
    return [*out, now] if now else out


def brute_chunks(text):
    lines = brute_lines(text)
    r = [hashlib.md5((lines[i - 1] if i else "").encode() + x.encode()).hexdigest() for i, x in enumerate(lines)]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        if i + 1 == len(lines) or (0 < i < len(lines) - 2 and r[i] < min(r[i - 1], r[i + 1])):
            out.append("".join(now))
            now = []
    return out


def brute_clean(texts):
    chunks = {i: brute_chunks(t) for i, t in texts.items() if t is not None}
    first = {}
    for i in sorted(chunks):
        for p, c in enumerate(chunks[i]):
            first.setdefault(c, (i, p))
    out = dict(texts)
    for i, own in chunks.items():
        gone, run = set(), []
        for p in range(len(own) + 1):
            again = p < len(own) and first[own[p]] != (i, p)
            if again:
                run.append(p)
            else:
                if sum(len(words(own[q])) for q in run) >= linededup.MIN_WORDS:
                    gone |= set(run)
                run = []
        if gone:
            out[i] = "".join(c for p, c in enumerate(own) if p not in gone)
    return out


def test_line_dedup_equals_brute_force(docs, rows, empty):
    expected = brute_clean({r[0]: r[1] for r in rows})
    got = {r["doc_id"]: r["text"] for r in linededup.clean(docs).collect()}
    assert got == expected
    assert sum(a != b for a, b in zip(got.values(), (r[1] for r in rows), strict=False)) > 0
    assert linededup.clean(docs).columns == docs.columns and linededup.clean(empty).count() == 0


def test_line_dedup_catches_a_passage_and_keeps_the_first(rows, docs):
    got = {r["doc_id"]: r["text"] for r in linededup.clean(docs).collect()}
    holders = [i for i, t, *_ in rows if t and "p1q1 " in t]
    assert "p1q1 " in got[holders[0]] and not any("p1q1 " in got[i] for i in holders[1:])
    assert all(got[i].startswith("own line") for i in holders)


@pytest.mark.parametrize("text", ["", "a", "a b", "a b ", " a", "\n\n", "x, y. z", "one two three four five six seven eight nine", "a,b c", "é ü\n\nñ", "  ", "a\r\nb\tc d"])
def test_chunks_put_together_give_the_text(spark, text):
    made = spark.createDataFrame([(text,)], "t string").select(linededup.chunks(F.col("t")).alias("c")).first()["c"]
    assert (made or []) == brute_chunks(text) and "".join(made or []) == text


def test_an_inserted_line_moves_no_other_boundary(spark):
    lines = [f"line {i} of some words, and more of them {i * i}\n" for i in range(60)]
    changed = [*lines[:30], "an inserted line\n", *lines[30:]]
    a, b = brute_chunks("".join(lines)), brute_chunks("".join(changed))
    assert len(a) > 25 and len(set(a) - set(b)) <= 2 and all(len(brute_lines(c)) >= 2 for c in a)


# 10. quality


def brute_measures(text):
    t = text or ""
    w = words(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_equals_brute_force(docs, rows, empty):
    out = by_id(quality.judge(docs))
    for i, text, *_ in rows:
        m, r = brute_measures(text), out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] or r["any_failed"]
    assert quality.judge(empty).count() == 0


def test_quality_filter_keeps_columns_and_clean_documents(docs, empty):
    kept = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    assert quality.keep_good(empty).count() == 0


def test_beta_prior_shrinks_towards_the_mean():
    a, b = quality.beta_prior(0.2, 0.01)
    assert a / (a + b) == pytest.approx(0.2) and a + b == pytest.approx(15)
    assert quality.beta_prior(None, None) == (0.0, 1.0) and quality.beta_prior(0.3, None) == (0.3, 0.7)


def test_beta_prior_takes_chance_off_the_variance():
    """Rates of 2,000 hosts of 10 documents each, drawn from a beta of strength 20: the prior finds that strength."""
    rng = np.random.default_rng(2)
    rates = rng.binomial(10, rng.beta(6, 14, 2000)) / 10
    a, b = quality.beta_prior(rates.mean(), rates.var(ddof=1), 0.1)
    assert 15 < a + b < 27 and a / (a + b) == pytest.approx(0.3, abs=0.02)
    a, b = quality.beta_prior(0.3, 0.3 * 0.7 * 0.1, 0.1)
    assert a + b == pytest.approx(quality.MOST_STRENGTH)


# nulls in every column, all operators


@pytest.fixture(scope="module")
def nulls(spark):
    text = " ".join(f"n{i}" for i in range(40))
    rows = [(None, text, None, None, None), (None, None, None, None, None), (None, text, "en", "s", 1), (5, text, None, None, None), (6, None, "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_null_ids_and_columns(nulls):
    words_path, bytes_path = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert sharding.shard_documents(nulls, 3).where("shard is null or slot is null").count() == 0
    assert mixing.mix(nulls).count() == 5 and mixing.mix(nulls).where("taken is null").count() == 0
    assert langid.identify(nulls).where("held_out is null or lang_pred is null").count() == 0
    assert bpe.round_trip_digests(nulls, words_path).count() == 5
    assert secrets.find_secrets(nulls).count() == 5
    near = minhash.near_duplicates(nulls, minhash.Settings()).collect()
    assert len(near) == 5 and {(r["id"], r["component"]) for r in near} == {(None, None), (5, 5), (6, 6)}
    exact = exactdedup.equal_groups(nulls).collect()
    assert Counter((r["id"], r["kept"]) for r in exact) == Counter([(None, False), (None, False), (None, False), (5, True), (6, True)])
    assert wavelet.round_trip(nulls, bytes_path).where("start is null").count() == 0
    assert linededup.clean(nulls).count() == 5
    judged = quality.judge(nulls)
    assert judged.count() == 5 and judged.where("kept is null").count() == 0
    assert quality.keep_good(nulls).count() == judged.where("kept").count()
