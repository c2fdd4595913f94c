"""Near-duplicates against all pairs on small tables; estimates against true similarities."""

import random
import re

import numpy as np
import pytest

from assaylake.llm import setsketch
from assaylake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def plain_components(docs, width):
    sets = [(d, plain_sets(t, width)) for d, t in docs]
    parent, counts = list(range(len(docs))), {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sizes = np.array([len(s) for _, s in sets])
    holders, of_id = {}, {}
    for j, (d, s) in enumerate(sets):  # every pair with a shingle in common, by counting the common ones
        shared = np.bincount(np.concatenate([holders[x][: counts[x]] for x in s if x in holders] or [np.zeros(0, int)]), minlength=j) if j else np.zeros(0, int)
        for i in np.flatnonzero((shared > 0) & (100 * shared >= 80 * (sizes[:j] + len(s) - shared))).tolist():
            parent[root(i)] = root(j)
        if s and d is not None:
            parent[root(of_id.setdefault(d, j))] = root(j)
        for x in s:
            if x not in holders:
                holders[x], counts[x] = np.zeros(4, int), 0
            if counts[x] == len(holders[x]):
                holders[x] = np.concatenate([holders[x], np.zeros_like(holders[x])])
            holders[x][counts[x]] = j
            counts[x] += 1
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(s), None if d is None else least[root(i)]) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_tables(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {tuple(r)[:3] for r in setsketch.near_duplicates(docs, width).collect()}
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], width)
    assert got == want
    assert sum(c != d for d, _, c in want) > 50


def test_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  B\t"), (8, "é É"), (9, "é É"), (10, "x " * 30_000), (11, "x " * 20_000)]
    for i in range(20, 140):  # a chain of texts, each a little further from the first
        docs.append((i, " ".join(base)))
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(words)
    for i in range(200, 260):
        copy = rng.choices(words, k=4) + docs[30][1].split()[4:]
        docs.append((i, " ".join(copy)))
    docs.append((30, docs[30 - 9][1]))
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, component_id int")
    got = {tuple(r)[:3] for r in setsketch.near_duplicates(frame.dropDuplicates(["doc_id"]), 2).collect()}
    plain = {r.doc_id: r.text for r in frame.dropDuplicates(["doc_id"]).collect()}
    assert got == plain_components(list(plain.items()), 2)
    assert setsketch.near_duplicates(frame.limit(0), 2).collect() == []
    null = setsketch.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c")], "doc_id long, text string"), 2).collect()
    assert sorted((str(r.doc_id), r.kept) for r in null) == [("3", True), ("None", False)]


def test_repeated_and_null_ids(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    a, b, c = (" ".join(rng.choices(words, k=150)) for _ in range(3))
    near = lambda t: t.replace(t.split()[70], "other", 1)
    for docs in (
        [(1, a), (1, b), (3, near(b))],
        [(5, a), (5, b), (3, near(a)), (4, near(b)), (9, c)],
        [(1, a), (None, near(a)), (2, near(near(a))), (None, c), (8, c), (7, ""), (7, b), (6, near(b))],
    ):
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = {tuple(r)[:3] for r in setsketch.near_duplicates(frame, 2).collect()}
        assert got == plain_components(docs, 2)


def test_many_sets_under_the_threshold_share_what_is_common(spark):
    """Sets of one size that share three quarters of their words: no links but the planted ones are found, none is lost."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    common = rng.choices(words, k=90)
    docs = []
    for i in range(300):
        docs.append((i, " ".join(common + rng.choices(words, k=35))))
    for i in range(0, 300, 7):
        docs.append((1000 + i, docs[i][1].rsplit(" ", 4)[0]))
    got = {tuple(r)[:3] for r in setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == plain_components(docs, 2)


def test_word_hashes_tell_words_apart_in_blocks():
    long = "a" * setsketch.TEXT_BLOCK
    text = f"{long} b {long} {long[:-1]} b " + "x y " * setsketch.TEXT_BLOCK
    words = text.encode().split()
    hashes = setsketch.word_hashes(text.encode())
    assert len(hashes) == len(words)
    seen = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    pool = setsketch.mixed(pool)
    for n, shared in ((200, 180), (1000, 500), (3000, 2900), (5000, 100)):
        a, b = pool[:n], pool[n - shared : 2 * n - shared]
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.merge(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
        true = shared / (2 * n - shared)
        got = setsketch.joint_estimate(ra[None], rb[None], np.array([n]), np.array([n]))[0]
        assert abs(got - true) < 0.2, (true, got)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200) if i % 40] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert got == parent
