"""The prefix trie against a plain trie over lists of turns, and against DuckDB."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from assaylake.llm import prefix_trie


def turn_key(turn, role, text):
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16])


def plain_nodes(rows, shared_heads=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: turn_key(*x))] for c, turns in convs.items()}
    built = dict(own)
    if shared_heads:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = sum(saved[p] for p in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (its[0], len(path), members[path[:-1]][0] if path else None, len(its), len(children[path]), leaves[path], saved[path], hashlib.sha256(",".join(str(c) for c in its if len(built[c]) == len(path)).encode()).hexdigest())
        for path, its in members.items()
    )


def found(spark, rows, **kinds):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("x"), "prior": F.lit(1), "t1": F.lit(None).cast("string"), "n_convs": F.lit(2), "pos": F.lit(3)})
    return sorted(map(tuple, prefix_trie.shared_prefixes(df, **kinds).select(*prefix_trie.NODE).collect()), key=lambda r: (r[0], r[1]))


ODD = [
    *[(0, t, "user", f"base {t}") for t in range(3)],
    *[(c, t, "user", "same") for c in (3, 7, 8, 9, -5, 150, 250) for t in range(4)],  # copies; 150 has a base that is absent or short
    (200, 0, "user", "short base"), (12, None, "user", "null turn"), (12, 0, None, None), (12, 0, "", ""), (12, 0, "a", "b"), (12, 0, "a", "b"),
    (None, 0, "user", "nobody's"), (None, None, None, None), (-100, 1, "x", "négatif 😀"), (-150, 1, "x", "y"), (5, 9, "user", "only"), (99, 1, "a", "1:b"), (98, 1, "a1:", "b"), (97, 1, None, "x" * 100_000),
]


def long_ones():
    """Conversations of many blocks, with copies, prefixes at block edges and one of several hundred turns."""
    rng = np.random.default_rng(8)
    base = [f"turn {i} {'é' * int(rng.integers(0, 9))}" for i in range(700)]
    rows = []
    for c, n in enumerate([700, 700, 8, 16, 17, 7, 9, 64, 65, 40, 40, 40, 1, 24, 24]):
        rows += [(c, t, "user", base[t] if c < 9 or t < 20 else f"{c % 2} {t}") for t in range(n)]
    return rows


@pytest.mark.parametrize("shared_heads", [True, False])
@pytest.mark.parametrize("rows", [ODD, long_ones(), long_ones() + ODD], ids=["odd", "long", "both"])
def test_trie_equals_the_plain_one(spark, rows, shared_heads):
    want = sorted(plain_nodes(rows, shared_heads), key=lambda r: (r[0], r[1]))
    assert found(spark, rows, shared_heads=shared_heads) == want


def test_trie_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    nodes = prefix_trie.shared_prefixes(spark.read.parquet(f"{sf}/conversations.parquet")).select(*prefix_trie.NODE)
    assert differences(nodes, connect(sf), prefix_trie.duckdb_sql()) is None


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_texts_and_links_of_nodes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (2, 1, "bot", None)], "conv_id long, turn long, role string, text string")
    nodes = {r.key: r for r in prefix_trie.shared_prefixes(df, shared_heads=False, with_text=True).collect()}
    assert sorted((r.depth, r.conv_id, r.role, r.text) for r in nodes.values() if r.depth) == [(1, 1, "user", "a"), (2, 1, "", "b"), (2, 2, "bot", "")]
    assert all(nodes[r.parent].depth == r.depth - 1 for r in nodes.values() if r.depth)


def test_end_digests_of_many_ids(monkeypatch, spark):
    """A key with thousands of ids over several partitions and chunks."""
    ends = spark.range(0, 30_000, 1, 7).select(F.when(F.col("id") % 3 > 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("key"), (F.col("id") - 500).alias("conv_id"))
    got = {bytes(r.key): r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert got[b"hot"] == hashlib.sha256(",".join(str(i - 500) for i in range(30_000) if i % 3).encode()).hexdigest()
    assert got[b"300"] == hashlib.sha256(b"-200").hexdigest() and len(got) == 10_001
