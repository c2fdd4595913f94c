"""Leader groups and ambiguous pairs against the one-by-one loop."""

import numpy as np
import pytest

from assaylake.operators import leaders


def plain(rows, tolerance):
    """leader of each id, and ambiguous (leader, id) pairs, by the loop over all rows."""
    led, groups, unsure = {}, {}, set()
    for block, i, v in sorted(rows, key=lambda r: r[1]):
        led[i] = i
        for j, w in groups.setdefault(block, []):
            if v is None or w is None or any(a is not None and b is not None and abs(a - b) > tolerance for a, b in zip(v, w, strict=True)):
                continue
            if None in v or None in w:
                unsure.add((j, i))
                continue
            led[i] = j
            break
        if led[i] == i:
            groups[block].append((i, v))
    return led, unsure


@pytest.mark.parametrize("first", [1024, 7, 1])
def test_groups_equal_the_loop(spark, monkeypatch, first):
    monkeypatch.setattr(leaders, "FIRST", first)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        block = ["a", "b", None][int(rng.integers(0, 3))]
        v = (rng.integers(0, 40, 3) / 8).tolist()  # a coarse grid: many ties at the tolerance and exact copies
        if i % 17 == 0:
            v[int(rng.integers(0, 3))] = None
        rows.append((block, int(i * 7 % 260), v if i % 50 else None))
    rows += [("dense", 1000 + i, (rng.random(3) * 0.6).tolist()) for i in range(60)] + [("dense", 2000 + i, [0.25, 0.25, 0.25]) for i in range(50)]
    rows += [("chain", 3000 + i, [i * 0.2, 0.0, 0.0]) for i in range(40)]  # each is near the one before
    df = spark.createDataFrame(rows, "block string, id long, v array<double>")
    groups, unsure = leaders.leader_groups(df, "block", "id", "v", 0.25)
    led, pairs = plain(rows, 0.25)
    assert {r.id: r.leader for r in groups.collect()} == led
    assert {(r.leader, r.id) for r in unsure.collect()} == pairs and pairs


def test_empty_and_one_axis(spark):
    df = spark.createDataFrame([("a", "x", [0.0, 5.0]), ("a", "y", [0.1, 5.0]), ("a", "z", [0.1, 9.0])], "block string, id string, v array<double>")
    groups, unsure = leaders.leader_groups(df, "block", "id", "v", 0.5, axes=(1,))
    assert {r.id: r.leader for r in groups.collect()} == {"x": "x", "y": "x", "z": "z"} and unsure.collect() == []
    groups, unsure = leaders.leader_groups(df.limit(0), "block", "id", "v", 0.5)
    assert groups.collect() == [] and unsure.collect() == []
