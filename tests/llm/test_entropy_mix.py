"""Mixing against a plain loop for the targets, and against the targets for the copies."""

import re

import pytest
from pyspark.sql import functions as F

from assaylake.llm import entropy_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    excess = total
    while excess > 1e-9 and open_:
        share = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / share
        excess = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                excess += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(docs, tolerance):
    rows = entropy_mix.decisions(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, entropy_mix.decisions(docs.repartition(5)).collect()), key=str)
    plain = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = {}
    for _, s, n in plain:
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, n) for d, _, n in plain)
    source = {d: s for d, s, _ in plain}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(tolerance * target[s], 1), (s, taken[s], target[s])


def test_tables(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), 0.1)
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.01)


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), [None, "a", "ä", "zz", "hot", "hot"][i % 6], "x") for i in range(300)] + [(900, None, "empty", None), (901, "", "empty", None), (902, " \t\n", "a", None), (5, "w " * 6, "hot", "x"), (5, "w " * 6, "hot", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    check(docs, 0.02)
    assert entropy_mix.decisions(docs.limit(0)).collect() == []
    mixed = entropy_mix.mix(docs)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in entropy_mix.decisions(docs).where("doc_id <> 5").collect()}
    counted = {r.doc_id: r.w for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(entropy_mix.WORD))).alias("w")).collect()}
    assert all((counted.get(d) or 0) == w for d, w in taken.items())
