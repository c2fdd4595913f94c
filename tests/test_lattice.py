"""Pairs of near lattices against all pairs."""

from collections import Counter

import numpy as np
import pytest

from assaylake.operators import lattice

SCHEMA = "id long, formula string, a double, b double, c double, alpha double, beta double, gamma double, volume double, left string"


def relation(x, y):
    """Of two tuples (a, b, c, alpha, beta, gamma, volume)."""
    gap = lambda p, q: abs(p - q) / ((p + q) / 2)
    both = lambda i: x[i] is not None and y[i] is not None
    size = lambda z, i: z[i] / np.cbrt(z[6])
    if any(both(i) and both(6) and gap(size(x, i), size(y, i)) > 0.2 for i in range(3)) or any(both(i) and abs(x[i] - y[i]) > 5 for i in (3, 4, 5)):
        return "distinct"
    if not all(map(both, range(7))):
        return "ambiguous"
    close = all(gap(x[i], y[i]) <= 0.02 for i in range(3)) and all(abs(x[i] - y[i]) <= 1 for i in (3, 4, 5)) and gap(x[6], y[6]) <= 0.03
    return "strict" if close else "scaled"


@pytest.mark.parametrize("part", [512, 3])
def test_pairs_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(lattice, "CELL_ROWS", part)
    rng = np.random.default_rng(part)
    rows = []
    for i in range(170):
        size = rng.choice([0.5, 1.0, 1.01, 2.0])
        lengths = (size * rng.choice([3.0, 3.05, 3.5, 4.2], 3)).tolist()
        row = [*lengths, *rng.choice([60.0, 60.5, 64.0, 90.0], 3).tolist(), float(size**3 * rng.choice([10.0, 10.1, 12.0]))]
        if i % 11 == 0:
            row[int(rng.integers(0, 7))] = None
        rows.append((i, ["F", "G", None][i % 3], *row, "x"))
    rows += [(1000 + i, "hot", 3.0, 3.0, 3.0, 90.0, 90.0, 90.0, 9.0, None) for i in range(40)] + [(2000 + i, "hot", 3.0, 3.0, 3.0 + i / 100, 90.0, 90.0, None if i == 7 else 90.0, 9.0, None) for i in range(30)]
    df = spark.createDataFrame([*rows, (5000, "F", -1.0, 3.0, 3.0, 60.0, 60.0, 60.0, 0.0, "y")], SCHEMA)
    rows.append((5000, "F", None, 3.0, 3.0, 60.0, 60.0, 60.0, None, "y"))
    members, pairs = lattice.near_lattices(df, "id", "formula")
    of = {r.id: r["class"] for r in members.collect()}
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:-1], r[0])
    assert of == {r[0]: first[r[1:-1]] for r in rows}
    want = Counter()
    for n, x in enumerate(rows):
        for y in rows[:n]:
            if x[1] == y[1] and (kind := relation(x[2:9], y[2:9])) != "distinct":
                want[min(of[x[0]], of[y[0]]), max(of[x[0]], of[y[0]]), kind] += 1
    found = pairs.collect()
    assert {(r.left, r.right, r.relation): r.n_pairs for r in found} == want and len(found) == len(want)
    assert {k for _, _, k in want} == {"strict", "scaled", "ambiguous"}


def test_empty(spark):
    members, pairs = lattice.near_lattices(spark.createDataFrame([], SCHEMA), "id", "formula")
    assert members.collect() == [] and pairs.collect() == []
