"""The trie against plain loops over all prefixes."""

import hashlib
import random
import zlib

import pytest
from assayer.llm import trie
from assayer.llm.queries import OP13_SQL, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[3], t[5]) for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    return out


def brute(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        under = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in under) or 1
        saved[p] = sum(saved[q] for q in under) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        yield min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], r[3], r[6]))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")


@pytest.mark.parametrize("seed,block_rows", [(0, 1000), (1, 3), (2, 1), (3, 7), (4, 40)])
def test_equals_plain_loops(spark, seed, block_rows):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(350), 120) + [100, 200]:
        for t in range(rnd.choice([1, 2, 3, 3, 5, 9, 30 if c % 7 == 0 else 4])):
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "é😀", "", None])))
    rows += [(r[0], 50, None, None) for r in rows[::17]] + rows[:3] + [(None, 1, "user", "lost")]
    got = trie.trie(trie.rebuilt(table(spark, rows)), block_rows)
    assert got.columns == COLUMNS
    assert order(map(tuple, got.collect())) == order(brute(rebuilt(rows)))


def test_shared_beginnings_and_copies(spark):
    rows = [(c, t, "user", f"{t}") for c in range(600) for t in range(12 + (c % 3 == 0))] + [(c, 20, "user", f"own {c % 50}") for c in range(600)]
    assert order(map(tuple, trie.trie(trie.rebuilt(table(spark, rows)), 4).collect())) == order(brute(rebuilt(rows)))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(700, 1, "user", "only")], [(8, 0, "user", "h takes it")], [(6, 0, "u", "a"), (7, 0, "u", "a")]])
def test_few_rows(spark, rows):
    assert order(map(tuple, trie.trie(trie.rebuilt(table(spark, rows))).collect())) == order(brute(rebuilt(rows)))


def test_a_very_long_conversation(spark):
    rows = [(1, t, "user", "x" * (t % 5)) for t in range(4000)] + [(101, t, "user", "x" * (t % 5)) for t in range(3990)]
    got = order(map(tuple, trie.trie(trie.rebuilt(table(spark, rows)), 1).collect()))
    want = {c: len(s) for c, s in rebuilt(rows).items()}
    assert max(r[1] for r in got) == max(want.values())
    assert sum(r[3] for r in got) == sum(want.values()) + len(want)


def test_digest_of_many_ids(spark):
    ids = list(range(0, 30_000, 2)) + [-5, -6000]
    members = spark.createDataFrame([(b"k", i) for i in ids] + [(b"", 9)], "key binary, conv_id long").repartition(7)
    got = {bytes(r.key): (r.n, r.least, r.ends_sha256) for r in trie.id_digests(members, 64).collect()}
    assert got == {b"k": (len(ids), -6000, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()), b"": (1, 9, hashlib.sha256(b"9").hexdigest())}


def test_query_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()
    assert order(map(tuple, queries()["op13_trie"](spark, folder).select(*COLUMNS).collect())) == order(want)
