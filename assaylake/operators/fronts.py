"""Numbering of dominance fronts: one more than the longest chain of better rows, without a round a front.

A row b beats a if b's worst value is at least a's best one on every axis and above it on one; with
worst = best this is plain dominance. The relation is transitive, so a row of one of the first K
fronts is beaten only by rows of earlier ones, and within any part of its group its number is at most
K. Groups of bounded size are numbered in one task. A larger group is cut into a grid by quantiles of two
axes: a cell needs only the cells that are as good on both, so the cells of one antidiagonal are
numbered at once, each in a task of its own, and pass on which values reach which number. Values
that a cell's rows can't tell apart are cut to one, so that little is passed on. Where a cell of a
group is too large for a task, since very many rows share values on both axes, the group is dealt
into blocks that number their rows; the counts of those numbers say how many fronts are sure to fit
in one task, and that task numbers what is left of them after the blocks, many fronts a round. Where
not even one front fits, blocks of its survivors are compared with all survivors by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt
from operator import and_, or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.sizes import few
from assaylake.session import drop_materialized, materialize, ship_package

BLOCK = 8192  # rows of a block of a large group, and about how many a cell of its grid has
FINE = 512  # cells of a grid along one axis at most
SMALL, BIN = 64, 8192  # rows of a small group, and about how many rows of small groups are numbered at once
MOST = 32_768  # rows of a group that one task numbers
STEP, TILE = 256, 8192  # rows that are numbered at once, and earlier ones that they are compared with at once
MEET = 1024  # rows, and points of other cells, that are compared at once


def chain_levels(worst: np.ndarray, best: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Of each row (values by axis) the length of the longest chain of rows, each beaten by the one before, that ends in it.

    before: the length of the longest chain from elsewhere whose last row beats this one.
    A beater's worst values come first in descending order, so rows are numbered in that order, against
    tiles of earlier rows whose highest number comes first.
    """
    n, axes = worst.shape
    ranks = [np.unique(np.concatenate([worst[:, k], best[:, k]]), return_inverse=True)[1].astype(np.int32) for k in range(axes)]
    rows, first_of, back = np.unique(np.stack([part for r in ranks for part in (-r[:n], r[n:])], axis=1), axis=0, return_index=True, return_inverse=True)
    order = np.lexsort(rows[:, ::2].T[::-1])
    low, high = np.ascontiguousarray(-rows[order, ::2].T), np.ascontiguousarray(rows[order, 1::2].T)
    low_sum, high_sum = low.sum(0, dtype=np.int64), high.sum(0, dtype=np.int64)
    count = len(order)
    level = np.ones(count, np.int64) if before is None else before[first_of[order]] + 1
    tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of finished rows: worst values, their sums and numbers

    def raise_by(base: np.ndarray, at: slice, values: np.ndarray, sums: np.ndarray, numbers: np.ndarray) -> None:
        if not len(numbers) or numbers[0] < base.min():
            return
        hit = values[0][None] >= high[0, at, None]
        for k in range(1, axes):
            hit &= values[k][None] >= high[k, at, None]
        hit &= sums[None] > high_sum[at, None]
        first = hit.argmax(1)
        found = hit[np.arange(len(first)), first]
        base[found] = np.maximum(base[found], numbers[first[found]] + 1)

    begun = 0
    for at in range(0, count, STEP):
        now = slice(at, min(at + STEP, count))
        base = level[now].copy()
        for tile in tiles:
            raise_by(base, now, *tile)
        down = begun + np.argsort(-level[begun:at], kind="stable")
        raise_by(base, now, low[:, down], low_sum[down], level[down])
        for i in range(at, now.stop):  # rows of the step itself
            beats = low_sum[at:i] > high_sum[i]
            for k in range(axes):
                beats &= low[k, at:i] >= high[k, i]
            level[i] = max(base[i - at], level[at:i][beats].max(initial=0) + 1)
        if now.stop - begun >= TILE:
            down = begun + np.argsort(-level[begun : now.stop], kind="stable")
            tiles.append((low[:, down], low_sum[down], level[down]))
            begun = now.stop
    out = np.zeros(count, np.int64)
    out[order] = level
    return out[back.reshape(-1)]


def reached(best: np.ndarray, points: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Of each row the highest number of a point that beats it, or 0. Points are met by falling numbers, and no row meets one after its first."""
    down = np.argsort(-numbers, kind="stable")
    by_axis, numbers, out = np.ascontiguousarray(points[down].T), numbers[down], np.zeros(len(best), np.int64)
    for at in range(0, len(best), MEET):
        open_rows = np.arange(at, min(at + MEET, len(best)))
        for begun in range(0, len(numbers), MEET):
            tile, high = by_axis[:, begun : begun + MEET], best[open_rows]
            hit, above = np.ones((len(high), tile.shape[1]), bool), np.zeros((len(high), tile.shape[1]), bool)
            for k, values in enumerate(tile):
                hit &= values[None] >= high[:, k, None]
                above |= values[None] > high[:, k, None]
            hit &= above
            first = hit.argmax(1)
            found = hit[np.arange(len(first)), first]
            out[open_rows[found]] = numbers[begun + first[found]]
            open_rows = open_rows[~found]
            if not len(open_rows):
                break
    return out


def _covered(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Of each of rows (axis by row) how many of by are at least as high on every axis, itself included."""
    hit = np.ones((rows.shape[1], by.shape[1]), bool)
    for mine, theirs in zip(rows, by, strict=True):
        hit &= theirs[None] >= mine[:, None]
    return hit.sum(1)


def needed(points: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points without those that another one with as high a number covers on every axis: what is left reaches the same.

    Points that differ on one axis only go by a sort. All others are compared where a few of them show that this pays.
    """
    for k in range(points.shape[1]):
        others = np.delete(points, k, axis=1)
        order = np.lexsort([-numbers, -points[:, k], *others.T])
        apart = np.concatenate([[False], (others[order][1:] != others[order][:-1]).any(1)])[: len(order)]
        key = np.cumsum(apart) * (numbers.max(initial=0) + 1) + numbers[order]
        keep = order[key > np.concatenate([[-1], np.maximum.accumulate(key)[:-1]])[: len(order)]]
        points, numbers = points[keep], numbers[keep]
    ranks = np.stack([np.unique(c, return_inverse=True)[1].astype(np.int32) for c in (*points.T, numbers)])
    some = ranks[:, :: len(numbers) // 256 + 1]
    if len(numbers) <= MEET or (_covered(some, ranks) > 1).mean() < 0.25:
        return points, numbers
    order = np.argsort(-ranks.sum(0, dtype=np.int64), kind="stable")
    kept: list[np.ndarray] = []
    for at in range(0, len(order), MEET):
        now = order[at : at + MEET]
        for tile in kept:
            now = now[_covered(ranks[:, now], ranks[:, tile]) == 0]
        kept.append(now[_covered(ranks[:, now], ranks[:, now]) == 1])
    keep = np.concatenate(kept)
    return points[keep], numbers[keep]


def small_levels(ids: np.ndarray, worst: np.ndarray, best: np.ndarray) -> np.ndarray:
    """chain_levels() of many small groups (ids) at once: the i-th rows of all groups meet the rows before them."""
    n, axes = worst.shape
    ranks = [np.unique(np.concatenate([worst[:, k], best[:, k]]), return_inverse=True)[1].astype(np.int32) for k in range(axes)]
    order = np.lexsort([*[-r[:n] for r in ranks[::-1]], ids])
    starts = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    of = np.cumsum(starts) - 1
    place = np.arange(n) - np.flatnonzero(starts)[of]
    most = int(place.max()) + 1
    low, high = np.full((axes, of[-1] + 1, most), -1, np.int32), np.zeros((axes, of[-1] + 1, most), np.int32)
    for k, r in enumerate(ranks):
        low[k, of, place], high[k, of, place] = r[:n][order], r[n:][order]
    low_sum, high_sum = low.sum(0, dtype=np.int64), high.sum(0, dtype=np.int64)
    level = np.ones((of[-1] + 1, most), np.int64)
    for i in range(1, most):
        beats = low_sum[:, :i] > high_sum[:, i, None]
        for k in range(axes):
            beats &= low[k, :, :i] >= high[k, :, i, None]
        level[:, i] = (level[:, :i] * beats).max(1) + 1
    out = np.zeros(n, np.int64)
    out[order] = level[of, place]
    return out


def _numbering(axes: int, name: str, ids: str | None):
    def number(part: pa.Table) -> pa.Table:
        worst, best = (np.stack([part[f"_{kind}{k}"].to_numpy() for k in range(axes)], axis=1) for kind in "wb")
        return part.append_column(name, pa.array(small_levels(part[ids].to_numpy(), worst, best) if ids else chain_levels(worst, best)))

    return number


def _numbered(rows: DataFrame, keys: list[str], axes: int, name: str, ids: str | None = None) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*keys).applyInArrow(_numbering(axes, name, ids), f"{schema}, `{name}` long")


def _one_front(left: DataFrame, axes: int) -> DataFrame:
    """Survivors that no other survivor beats, for groups whose first front is too large for a task.

    Each side is dealt apart: blocks of rows meet all rows of their group one after the other.
    """
    sizes = left.groupBy("_g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_blocks"))
    dealt = left.join(sizes, "_g")
    mine = dealt.withColumn("_block", F.pmod(F.xxhash64("_r"), F.col("_blocks")).cast("int")).drop("_blocks")
    others = dealt.select(F.col("_g").alias("_h"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_c"), *[F.col(f"_{x}{k}").alias(f"_o{x}{k}") for x in "wb" for k in range(axes)])
    beaten = reduce(and_, [F.col(f"_ow{k}") >= F.col(f"_b{k}") for k in range(axes)]) & reduce(or_, [F.col(f"_ow{k}") > F.col(f"_b{k}") for k in range(axes)])
    return mine.join(others, (F.col("_g") == F.col("_h")) & (F.col("_block") == F.col("_c")) & beaten, "left_anti").drop("_block")


def _dense_fronts(rest: DataFrame, axes: int) -> list[DataFrame]:
    """(_r, front) tables of groups of more than MOST rows of which very many share values."""
    found, by_number = [], Window.partitionBy("_g").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    columns = rest.columns
    rest = rest.withColumn("_base", F.lit(0).cast("long"))
    while not rest.isEmpty():
        sizes = rest.groupBy("_g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_blocks"))
        dealt = rest.join(sizes, "_g").withColumn("_block", F.pmod(F.xxhash64("_r", "_blocks"), F.col("_blocks"))).drop("_blocks")
        local = materialize(_numbered(dealt, ["_g", "_block"], axes, "_n").drop("_block"), "local")
        upto = local.groupBy("_g", "_n").agg(F.count("*").alias("_c")).withColumn("_c", F.sum("_c").over(by_number))
        fit = materialize(upto.groupBy("_g").agg(F.max(F.when(F.col("_c") <= MOST, F.col("_n"))).alias("_k")), "fit")
        near = local.join(fit, "_g").where(F.col("_n") <= F.coalesce("_k", F.lit(1)))
        fitting = near.where("_k is not null").drop("_n")
        top = _numbered(fitting, ["_g"], axes, "_f").where("_f <= _k").select("_r", (F.col("_base") + F.col("_f")).alias("front"))
        if not fit.where("_k is null").isEmpty():
            one = _one_front(near.where("_k is null").select(*columns, "_base"), axes)
            top = top.unionByName(one.select("_r", (F.col("_base") + 1).alias("front")))
        top = materialize(top, "front")
        found.append(top)
        steps = fit.select("_g", F.coalesce("_k", F.lit(1)).alias("_done"))
        left = local.drop("_n").join(top.select("_r"), "_r", "left_anti").join(steps, "_g")
        rest = materialize(left.withColumn("_base", F.col("_base") + F.col("_done")).select(*columns, "_base"), "rest")
    return found


class _Grid(NamedTuple):
    """A group's grid: the number of its first bin among those of all groups, of each bin of an axis the highest best value in it or in a worse one, and of each bin of the first axis the last bin of the second that has a row there or in a worse one."""

    offset: int
    tops: tuple[np.ndarray, np.ndarray]
    reach: np.ndarray


def _next_cells(grid: _Grid, axes: list[int], i: int, j: int, own: tuple, above: tuple, left: tuple) -> Iterator[tuple]:
    """(i, j, kind, points, numbers) for the cell below, which gets all that this one knows, and for the one to the right, which gets what is of its own bin of the first axis."""
    for kind, (x, y), parts in ((1, (i + 1, j), (own, above, left)), (2, (i, j + 1), (own, left))):
        if x >= len(grid.reach) or y > grid.reach[x]:
            continue
        points, numbers = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        for k, top in zip(axes, (grid.tops[0][x], grid.tops[1][y]), strict=False):
            points[:, k] = np.minimum(points[:, k], np.nextafter(top, np.inf))
        yield x, y, kind, *needed(points, numbers)


def _cells(axes: int, cut: list[int], grids: dict[int, _Grid]):
    """Numbers the cells of an antidiagonal. Rows have kind 0; points from the cell above have kind 1, those from the left kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        part = pa.Table.from_batches(held)
        group, i, j, kind, number, row = (part[c].to_numpy() for c in ("_id", "_i", "_j", "_kind", "_n", "_r"))
        worst, best = (np.stack([part[f"_{x}{k}"].to_numpy() for k in range(axes)], axis=1) for x in "wb")
        order = np.lexsort([j, i, group])
        changes = reduce(or_, [c[order][1:] != c[order][:-1] for c in (group, i, j)])
        for at in np.split(order, np.flatnonzero(changes) + 1):
            g, x, y = int(group[at[0]]), int(i[at[0]]), int(j[at[0]])
            mine, above, left = (at[kind[at] == k] for k in range(3))
            points = np.concatenate([above, left])
            levels = chain_levels(worst[mine], best[mine], reached(best[mine], worst[points], number[points])) if len(mine) else np.zeros(0, np.int64)
            made = [(x, y, 0, np.zeros((len(mine), axes)), levels)]
            made += _next_cells(grids[g], cut, x, y, (worst[mine], levels), (worst[above], number[above]), (worst[left], number[left]))
            for to_i, to_j, of_kind, values, numbers in made:
                n = len(numbers)
                whole = {"_id": g, "_o": grids[g].offset, "_i": to_i, "_j": to_j, "_kind": of_kind, "_r": 0, **{f"_b{k}": 0.0 for k in range(axes)}}
                columns = {c: np.full(n, v, part.schema.field(c).type.to_pandas_dtype()) for c, v in whole.items()}
                columns |= {"_n": numbers, **{f"_w{k}": values[:, k] for k in range(axes)}} | ({"_r": row[mine]} if of_kind == 0 else {})
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in part.column_names})

    return run


def _dealt(rest: DataFrame, axes: int) -> tuple[DataFrame, list[int], dict[int, _Grid], set[int], set[int]]:
    """rest with the cell (_i, _j) of each row, the axes that are cut, the grids, the antidiagonals with rows, and the groups that no grid of FINE bins cuts into cells of at most MOST rows.

    The axes are those with the most values; a grid gets finer until its largest cell fits. Bins are
    numbered from the best one, and rows that are equal on an axis have the same.
    """
    counts = rest.groupBy("_id").agg(F.count("*").alias("n"), *[F.approx_count_distinct(f"_w{k}").alias(f"d{k}") for k in range(axes)]).collect()
    cut = sorted(range(axes), key=lambda k: (-sum(c[f"d{k}"] for c in counts), k))[:2]
    at = [k / FINE for k in range(1, FINE)]
    quantiles = {q._id: q for q in rest.groupBy("_id").agg(*[F.percentile_approx(f"_w{k}", at).alias(f"q{k}") for k in cut]).collect()}
    side = {c._id: min(FINE, ceil(sqrt(c.n / BLOCK)) if axes > 1 else ceil(c.n / MOST)) for c in counts}
    while True:
        offsets, told = {}, []
        for g, q in quantiles.items():
            cuts = [sorted({q[f"q{k}"][m * FINE // side[g] - 1] for m in range(1, side[g])}) for k in cut]
            offsets[g] = sum(len(t[2]) + 1 for t in told)
            told.append((g, offsets[g], cuts[0], cuts[1] if axes > 1 else []))
        plan = rest.sparkSession.createDataFrame(told, "_id long, _o long, _x array<double>, _y array<double>")
        bin_of = lambda cuts, k: F.size(F.filter(cuts, lambda c: c > F.col(f"_w{k}")))
        dealt = rest.join(few(plan), "_id").withColumn("_i", bin_of("_x", cut[0])).withColumn("_j", bin_of("_y", cut[-1])).drop("_x", "_y")
        cells = dealt.groupBy("_id", "_i", "_j").agg(F.count("*").alias("n"), F.max(f"_b{cut[0]}").alias("x"), F.max(f"_b{cut[-1]}").alias("y")).collect()
        coarse = {c._id for c in cells if c.n > MOST}
        finer = {g for g in coarse if side[g] < FINE}
        if not finer:
            break
        side |= {g: min(FINE, 2 * side[g]) for g in finer}
    of: dict[int, list] = {}
    for c in cells:
        of.setdefault(c._id, []).append(c)
    grids, best_from = {}, lambda a: np.maximum.accumulate(a[::-1])[::-1]
    for g, found in of.items():
        rows, columns = (max(c[k] for c in found) + 1 for k in ("_i", "_j"))
        x, y, reach = np.full(rows, -np.inf), np.full(columns, -np.inf), np.full(rows, -1)
        for c in found:
            x[c._i], y[c._j], reach[c._i] = max(x[c._i], c.x), max(y[c._j], c.y), max(reach[c._i], c._j)
        grids[g] = _Grid(offsets[g], (best_from(x), best_from(y)), best_from(reach))
    return dealt, cut, grids, {c._i + c._j for c in cells if c._id not in coarse}, coarse


def _large_fronts(rest: DataFrame, axes: int) -> list[DataFrame]:
    """(_r, front) tables of groups of more than MOST rows, one antidiagonal of their grids after the other."""
    rest = materialize(rest, "large")
    dealt, cut, grids, sums, coarse = _dealt(rest, axes)
    found = _dense_fronts(rest.where(F.col("_id").isin(coarse)).drop("_id"), axes) if coarse else []
    if not sums:
        return found
    columns = ["_id", "_o", "_i", "_j", "_kind", "_n", "_r", *[f"_{x}{k}" for x in "wb" for k in range(axes)]]
    dealt = dealt.where(~F.col("_id").isin(coarse)) if coarse else dealt
    dealt = dealt.select("*", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"), (F.col("_i") + F.col("_j")).alias("_s")).select("_s", *columns)
    dealt = materialize(dealt.repartitionByRange("_s", "_i", "_id").sortWithinPartitions("_s"), "cells")
    parts = min(sum(len(g.reach) for g in grids.values()), 4 * rest.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in columns)
    waves: list[DataFrame] = []
    for s in range(min(sums), max(sums) + 1):
        part = dealt.where(F.col("_s") == s).select(*columns)
        if waves:
            part = part.unionByName(waves[-1].where("_kind > 0"))
        # A group has one cell of each bin of the first axis here, so neighbours are in tasks of their own.
        spread = part.repartitionById(parts, F.pmod(F.col("_o") + F.col("_i"), F.lit(parts)).cast("int"))
        waves.append(materialize(spread.mapInArrow(_cells(axes, cut, grids), schema), "wave"))
    fronts = [w.where("_kind = 0").select("_r", F.col("_n").alias("front")) for w in waves]
    found.append(materialize(reduce(DataFrame.unionByName, fronts), "front"))
    drop_materialized(rest, dealt, *waves)
    return found


def all_fronts(rows: DataFrame, entity: str, group: str, axes: list[tuple[Column, Column]]) -> DataFrame:
    """(entity, front) for rows whose axes, as (worst, best) with more being better, are all known.

    Rows with a null axis have no front; equal rows share one; rows of a null group are a group, and
    rows may share an entity; an empty table gives no rows.
    """
    ship_package(rows.sparkSession)
    values = {f"_{x}{k}": c.cast("double") for k, pair in enumerate(axes) for x, c in zip("wb", pair, strict=True)}
    # A group in a struct is never null in joins; distinct values are told apart by a number that is written once.
    known = rows.select(F.col(entity).alias("_e"), F.struct(F.col(group).alias("g")).alias("_g"), *[c.alias(n) for n, c in values.items()]).dropna(subset=list(values))
    known = materialize(known, "known")
    same = ["_g", *values]
    classes = materialize(known.select(*same).distinct().withColumn("_r", F.monotonically_increasing_id()), "classes")
    few = min(SMALL, MOST)
    sizes = classes.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_r").alias("_id"))
    count = sizes.agg(F.coalesce(F.sum(F.when(F.col("_n") <= few, F.col("_n"))), F.lit(0)).alias("small"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    sized = classes.join(sizes, "_g")
    bins = count.small // BIN + 1
    small = sized.where(F.col("_n") <= few).select("_r", "_id", *values, F.pmod(F.xxhash64("_id"), F.lit(bins)).alias("_bin"))
    parts = [_numbered(small, ["_bin"], len(axes), "front", "_id").select("_r", "front")]
    if count.most > few:
        middle = sized.where((F.col("_n") > few) & (F.col("_n") <= MOST)).select("_g", "_r", *values)
        parts.append(_numbered(middle, ["_g"], len(axes), "front").select("_r", "front"))
    if count.most > MOST:
        parts += _large_fronts(sized.where(F.col("_n") > MOST).select("_id", "_g", "_r", *values), len(axes))
    out = classes.join(reduce(DataFrame.unionByName, parts), "_r").drop("_r")
    return known.join(out, same).select(F.col("_e").alias(entity), "front")
