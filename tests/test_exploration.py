"""The five branches against plain sorting."""

import random

from assaylake.operators import exploration

SCHEMA = "id long, pool string, stability double, target double, diversity double, disagreement double, pareto boolean, rank long"


def test_branches(spark):
    rng = random.Random(2)
    maybe = lambda: rng.choice([None, 0.1, 0.5, 0.5, 0.9])
    rows = [(i, p := rng.choice(["a", "b", None, "bare", "flat"]), None if p in ("bare", "flat") else maybe(), maybe(), maybe(), maybe(), p != "flat" and rng.random() < 0.3, 7) for i in range(80)]
    got = {}
    for r in exploration.explore(spark.createDataFrame(rows, SCHEMA), "id", "pool", 3, 0.5).collect():
        got[r.pool, r.branch, r["rank"]] = (r.id, r.score, r.reason)
    want = {}
    for p in {r[1] for r in rows}:
        its = [r for r in rows if r[1] == p]
        for branch, at, part in (("stability", 2, its), ("target", 3, its), ("diversity", 4, its), ("pareto", 3, [r for r in its if r[6]])):
            for n, r in enumerate(sorted((r for r in part if r[at] is not None), key=lambda r: (-r[at], r[0]))[:3], 1):
                want[p, branch, n] = (r[0], r[at], None)
        known = sorted((r for r in its if r[5] is not None and r[5] >= 0.5), key=lambda r: (-r[5], r[0]))[:3]
        want |= {(p, "disagreement", n): (r[0], r[5], None) for n, r in enumerate(known, 1)}
        if unknown := sorted(r[0] for r in its if r[5] is None):
            want[p, "disagreement", min(len(known) + 1, 3)] = (unknown[0], None, "disagreement_unknown")
        if not any(r[2] is not None for r in its):
            first = min([r for r in its if r[6]] or its, key=lambda r: (-(r[3] if r[3] is not None else -9), r[0]))
            want[p, "stability", 1] = (first[0], None, exploration.FALLBACK)
    assert got == want
    assert exploration.explore(spark.createDataFrame([], SCHEMA), "id", "pool", 3).collect() == []
