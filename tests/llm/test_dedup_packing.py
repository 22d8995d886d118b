"""Exact dedup, SimHash and packing against brute force on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from assayer.llm import exact_dedup, graph, packing, simhash
from assayer.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, sha string, key string, size long"


def texts(seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "x", "ΣΑΣ", "0"]
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(300)) for _ in range(rnd.choice([0, 1, 3, 40, 400]))) for _ in range(60)]
    near = [t + " tail" for t in base[:30]] + [t.replace("alpha", "alphb", 1) for t in base[30:]]
    return base + near + base[:25] + base[:5] + [None, "", " \t\n", None, "\x85  ", "word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "clash", None, 1) for i, t in enumerate(texts())]
    rows += [(None, "no id", None, "a", "b", 2), (7, rows[7][1], "en", None, "k", 3)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for s, n in Counter(shingles).items():
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += n * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = [r for r in docs.collect()]
    assert len(got) == len(rows)
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    mine = {r.id: r.fp % 2**64 for r in got}
    assert all(mine[i] == f for i, f in fps.items())
    ids = [r.doc_id for r in rows]
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (mine[ids[a]] ^ mine[ids[b]]).bit_count() <= 4])
    smallest = defaultdict(list)
    for i, r in enumerate(root):
        smallest[r].append(ids[i])
    want = sorted((str(ids[i]), str(min((x for x in smallest[root[i]] if x is not None), default=None))) for i in range(len(rows)))
    assert want == sorted((str(r.id), str(r.component)) for r in got)


def test_dense_near_fingerprints_all_link(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(150):
            f = centre
            for _ in range(rnd.randrange(6)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {r.fp: r.root for r in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    root = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 4])
    for i, f in enumerate(fps):
        assert got.get(f, f) == fps[root[i]]


def test_manhattan_never_exceeds_hamming(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b"))
    low, exact = simhash.manhattan(simhash.embed(F.col("a")), simhash.embed(F.col("b"))), F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    rows = df.select("a", "b", low.alias("low"), exact.alias("exact")).collect()
    for r in rows:
        a, b = r.a % 2**64, r.b % 2**64
        assert r.low == sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2)) <= r.exact


def test_components_of_long_path(spark):
    pairs = [(i, i + 1) for i in range(1, 200)] + [(500, 400), (400, 500), (9, 9), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 400: 400, 500: 400}


def test_exact_groups(spark, docs):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for r in rows:
        mine = [g for g in got if g.id == r.doc_id]
        assert {(g.keep_id, g.group_size) for g in mine} == {(max((i for i in groups[r.text or ""] if i is not None), default=None), len(groups[r.text or ""]))}
    assert sum(g.kept for g in got) == len(groups)
    small = exact_dedup.exact_groups(docs, max_bits=1 << 16, per_row=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    assert exact_dedup.filter_size(len(rows), 1 << 16, 1 << 22)[1] > 1
    parts = exact_dedup.exact_groups(docs, max_bits=1 << 22, per_row=1 << 16).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))


def test_filter_finds_all_repeated_keys(spark):
    """In tasks of one row or many: repeated keys are always suspects, others rarely."""
    keys = [(i * 0x9E3779B97F4A7C15 + 5) % (1 << 64) - (1 << 63) for i in range(4000)]
    frame = spark.createDataFrame([(k,) for k in keys + keys[:50] + keys[:1] * 300], "key long").repartition(7)
    for flush in (16, 4_000_000):
        packed = exact_dedup.repeated_bits(frame, 1 << 18, flush)
        marked = exact_dedup.mark_suspects(frame, "key", 1 << 18, spark.sparkContext.broadcast(packed)).where("__suspect").collect()
        found = {r.key for r in marked}
        assert set(keys[:50]) <= found and len(found) < 100


def test_drop_functions_keep_columns(spark, docs):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r.text or "" for r in docs.collect()})
    parts = exact_dedup.drop_exact_duplicates(docs, max_bits=1 << 20, per_row=1 << 14)
    assert sorted(map(str, parts.collect())) == sorted(map(str, kept.collect()))
    near = simhash.drop_near_duplicates(docs.where("doc_id is not null"))
    assert near.columns == docs.columns


def test_odd_column_names_pass_through(spark):
    from assayer.llm import quality, toxicity

    odd = spark.createDataFrame([(1, "a b", 1, {"k": [1]}), (2, "a b", 2, None)], "doc_id long, text string, `suspect` int, `a.b c` map<string,array<int>>")
    model = toxicity.ToxicityModel({b"a": 1.0}, -0.1)
    plain = quality.QualityModel(np.zeros((quality.WIDTH, 256, quality.FILTERS), np.float32), np.zeros(quality.FILTERS, np.float32), np.zeros(quality.FILTERS), 1.0)
    for kept in (exact_dedup.drop_exact_duplicates(odd), simhash.drop_near_duplicates(odd), toxicity.drop_toxic(odd, model, 2.0), quality.keep_good(odd, plain)):
        assert kept.columns == odd.columns and kept.count() in (1, 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_is_a_gapless_partition(spark, docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = docs.collect()
    got = packing.pack_documents(docs, tokenizer_path(), capacity=capacity, slack=0, group=40).collect()
    want = []
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            want.append((str(r.doc_id), piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted((str(g.id), g.piece, g.start, g.length, g.ids_crc32) for g in got)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.05 * total / capacity + 3


def test_best_fit_matches_plain_best_fit():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 101, 400)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(400))
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms[rooms.index(min(fit))] -= s
        else:
            rooms.append(100 - s)
    assert len(rooms) == len(bins)
