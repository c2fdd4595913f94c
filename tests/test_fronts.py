"""Front numbers against peeling, in one task, in blocks, and where one front alone is too large for a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import fronts


def peeled(worst, best):
    level, rest, front = np.zeros(len(worst), int), np.ones(len(worst), bool), 0
    beats = (worst[:, None] >= best[None]).all(2) & (worst[:, None] > best[None]).any(2)
    while rest.any():
        front += 1
        top = rest & ~beats[rest].any(0)
        level[top] = front
        rest &= ~top
    return level


@pytest.mark.parametrize("axes", [1, 2, 4])
@pytest.mark.parametrize("n", [0, 1, 257, 900])
def test_levels_equal_peeling(monkeypatch, axes, n):
    monkeypatch.setattr(fronts, "STEP", 32)
    monkeypatch.setattr(fronts, "TILE", 100)
    rng = np.random.default_rng(n + axes)
    for high in (4, 50):
        worst = rng.integers(0, high, (n, axes)).astype(float)
        for best in (worst, worst + rng.integers(0, 3, (n, axes))):
            assert (fronts.chain_levels(worst, best) == peeled(worst, best)).all()


@pytest.mark.parametrize(("most", "block"), [(32_768, 8192), (60, 25), (10, 6)])
def test_groups_of_all_sizes(spark, monkeypatch, most, block):
    """Random rows, a chain, an antichain (one front of all rows), copies, a null group and a null entity."""
    monkeypatch.setattr(fronts, "MOST", most)
    monkeypatch.setattr(fronts, "BLOCK", block)
    rng = np.random.default_rng(most)
    groups = {
        "random": rng.integers(0, 12, (150, 2)), "chain": np.repeat(np.arange(40)[:, None], 2, 1), "antichain": np.stack([np.arange(90), -np.arange(90)], 1),
        None: rng.integers(0, 4, (70, 2)), "copies": np.ones((80, 2), int), "small": rng.integers(0, 9, (5, 2)),
    }
    rows, want = [], {}
    for g, worst in groups.items():
        best = worst + rng.integers(0, 2, worst.shape) * (g != "antichain")
        for i, (w, b, front) in enumerate(zip(worst.tolist(), best.tolist(), peeled(worst, best).tolist(), strict=True)):
            key = f"{g}-{i}" if (g, i) != ("random", 3) else None
            rows.append((key, g, float(w[0]), float(b[0]), float(w[1]), float(b[1])))
            want[key] = front
    rows.append(("unknown", "random", 1.0, 1.0, None, 1.0))
    df = spark.createDataFrame(rows, "id string, g string, w0 double, b0 double, w1 double, b1 double")
    got = fronts.all_fronts(df, "id", "g", [(F.col("w0"), F.col("b0")), (F.col("w1"), F.col("b1"))]).collect()
    assert len(got) == len(want) and {r.id: r.front for r in got} == want
    assert fronts.all_fronts(df.limit(0), "id", "g", [(F.col("w0"), F.col("b0"))]).collect() == []


@pytest.mark.parametrize("axes", [1, 2, 4])
@pytest.mark.parametrize("high", [4, 30, 10**6])
def test_needed_points_reach_what_all_reach(monkeypatch, axes, high):
    monkeypatch.setattr(fronts, "MEET", 64)
    rng = np.random.default_rng(axes)

    def plain(best, points, numbers):
        beats = (points[None] >= best[:, None]).all(2) & (points[None] > best[:, None]).any(2)
        return np.where(beats, numbers[None], 0).max(1, initial=0)

    for n in (0, 1, 50, 900):
        points, numbers, rows = rng.integers(0, high, (n, axes)).astype(float), rng.integers(1, 9, n), rng.integers(0, high, (200, axes)).astype(float)
        few = fronts.needed(points, numbers)
        for best in (rows, points):
            want = plain(best, points, numbers)
            assert (fronts.reached(best, points, numbers) == want).all() and (fronts.reached(best, *few) == want).all()
        assert n < 900 or len(few[1]) < 600


@pytest.mark.parametrize(("fine", "wide"), [(512, 3), (2, 0)])
def test_distinct_values_of_large_groups_take_few_rounds(spark, monkeypatch, fine, wide):
    """Two groups without equal rows: a round for each MOST rows of fronts wrote more than 40 tables here. Two bins an axis are too few: the rest goes by blocks."""
    monkeypatch.setattr(fronts, "MOST", 60)
    monkeypatch.setattr(fronts, "BLOCK", 24)
    monkeypatch.setattr(fronts, "FINE", fine)
    written, write = [], fronts.materialize
    monkeypatch.setattr(fronts, "materialize", lambda df, name: written.append(name) or write(df, name))
    rng = np.random.default_rng(fine + wide)
    rows, want = [], {}
    for g, n in (("a", 500 if fine > 2 else 150), ("b", 130)):
        worst = np.concatenate([rng.permutation(n)[:, None], rng.integers(0, 3, (n, 1)), rng.permutation(n)[:, None]], axis=1).astype(float)
        best = worst + rng.integers(0, wide + 1, worst.shape)
        rows += [(f"{g}{i}", g, *map(float, w), *map(float, b)) for i, (w, b) in enumerate(zip(worst, best, strict=True))]
        want |= {f"{g}{i}": front for i, front in enumerate(peeled(worst, best).tolist())}
    df = spark.createDataFrame(rows, "id string, g string, w0 double, w1 double, w2 double, b0 double, b1 double, b2 double")
    got = fronts.all_fronts(df, "id", "g", [(F.col(f"w{k}"), F.col(f"b{k}")) for k in range(3)]).collect()
    assert len(got) == len(want) and {r.id: r.front for r in got} == want
    assert fine == 2 or len(written) < 30
