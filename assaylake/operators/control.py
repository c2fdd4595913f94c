"""Stateful control: the adaptive controller's fold, branch allocation, trends and set improvement, in batch and as folds for streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log, sqrt
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import materialize, ship_package


@dataclass(frozen=True)
class Limits:
    """Steps, clamps and tolerances of the controller; history is how many observations make a trend.

    guided is for generators whose alpha is a guidance weight: more of it exploits, where a plain alpha
    exploits by less.
    """

    temperature: tuple[float, float] = (0.01, 5.0)
    unit: tuple[float, float] = (0.0, 1.0)
    history: int = 2
    improvement_epsilon: float = 1e-9
    collapse_epsilon: float = 1e-6
    alpha_step: float = 0.1
    temperature_step: float = 0.2
    mutation_step: float = 0.1
    diversity_step: float = 0.05
    guided: bool = False


START = {"temperature": 1.0, "alpha": 0.5, "mutation": 0.2, "diversity": 0.3, "previous_collapse": None, "recent": ()}
BLOCK = 4096  # members of a set that are compared at once
OBSERVED = ("objective_improvement", "structural_collapse_rate", "failed")  # of an observation that rewards an arm
CONTROLS = ("alpha", "temperature", "mutation", "diversity")


def clamp(x: float, bounds: tuple[float, float]) -> float:
    return round(min(max(x, bounds[0]), bounds[1]), 12)


def step(state: dict, improvement: float, collapse: float, disagreement: bool, limits: Limits = Limits()) -> tuple[dict, list[str]]:
    """The next controls after one observation, and why they changed.

    One of three trends counts, the first that holds: more collapse than at the observation before
    (there is none at the first) cools; improvements above the tolerance all through the window
    exploit; improvements within the tolerance of zero all through it explore. Disagreement diversifies besides.
    """
    recent = (*state["recent"], improvement)[-limits.history :]
    full, before = len(recent) == limits.history, state["previous_collapse"]
    change, guide = dict.fromkeys(CONTROLS, 0.0), limits.alpha_step * limits.guided
    if before is not None and collapse > before + limits.collapse_epsilon:
        why = "collapse_increased"
        change |= {"temperature": -limits.temperature_step, "mutation": -limits.mutation_step, "alpha": -guide}
    elif full and min(recent) > limits.improvement_epsilon:
        why = "sustained_improvement"
        change["alpha"] = guide or -limits.alpha_step
    elif full and max(map(abs, recent)) <= limits.improvement_epsilon:
        why = "stagnation"
        change |= {"temperature": limits.temperature_step, "mutation": limits.mutation_step, "diversity": limits.diversity_step, "alpha": -guide}
    else:
        why = "no_trend"
    change["diversity"] += limits.diversity_step * disagreement
    after = {k: clamp(state[k] + v, limits.temperature if k == "temperature" else limits.unit) for k, v in change.items()}
    return {**after, "previous_collapse": collapse, "recent": recent}, [why, "disagreement"] if disagreement else [why]


def bounded(parts: Iterator[pd.DataFrame] | list[pd.DataFrame], most: int, what: str) -> pd.DataFrame:
    """A group's rows in one frame; raises beyond ``most`` rather than filling a worker's memory."""
    kept, n = [], 0
    for part in parts:
        n += len(part)
        if n > most:
            raise ValueError(f"a {what} has more than {most} observations")
        kept.append(part)
    return pd.concat(kept, ignore_index=True)


def scheduler_trace(observations: DataFrame, branch: str = "branch_id", order: str = "round_index", limits: Limits = Limits(), most: int = 1_000_000) -> DataFrame:
    """Controls after each observation of a branch in the order of its rounds (the batch twin of the stream).

    A fold has to see a branch's rounds in order; a branch of more than ``most`` observations is an error.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, state, rows = bounded([part], most, "branch").sort_values(order, ignore_index=True), START, []
        for x in part.itertuples():
            state, why = step(state, x.objective_improvement, x.structural_collapse_rate, bool(x.high_disagreement), limits)
            rows.append((getattr(x, branch), getattr(x, order), *(state[k] for k in CONTROLS), ";".join(why)))
        return pd.DataFrame(rows, columns=[branch, order, *CONTROLS, "reasons"])

    needed = observations.select(branch, order, "objective_improvement", "structural_collapse_rate", "high_disagreement")
    return needed.groupBy(branch).applyInPandas(fold, f"{branch} {observations.schema[branch].dataType.simpleString()}, {order} long, {', '.join(f'{k} double' for k in CONTROLS)}, reasons string")


def reward(weight: float, improvement: float | None, collapse: float, failed: bool) -> float:
    """An arm's weight after an observation; an unknown improvement counts as none."""
    gain = 0.0 if improvement is None or improvement != improvement else 0.2 * min(1.0, max(-1.0, improvement))
    return min(1.5, max(0.0, weight + gain - 0.35 * min(1.0, max(0.0, collapse)) - 0.5 * failed))


@dataclass
class Arms:
    """State of one bundle's allocation: weights (the arms' priorities at first), uses and what each worker of the round has."""

    weights: list[float]
    used: list[int]

    def choose(self) -> int:
        """The arm with the greatest weight plus bonus for few uses; ties go to the first."""
        total = 1 + sum(self.used)
        bounds = [w + sqrt(2 * log(total + 1) / (n + 1)) for w, n in zip(self.weights, self.used, strict=True)]
        arm = bounds.index(max(bounds))
        self.used[arm] += 1
        return arm


def allocated(rounds: list, names: list, improvements: list, collapses: list, failures: list, arms: Arms) -> list[tuple[int, object, int, float]]:
    """Rows (round, worker, arm, its weight after the observation) of one bundle, from the columns of its observations.

    All workers of a round choose before any of it is rewarded, in the order of their names, and a
    worker that asks again in a round keeps its arm. Observations of an unknown round aren't taken.
    """
    rows, at, count = [], 0, len(rounds)
    order = [i for i in range(count) if rounds[i] is not None and rounds[i] == rounds[i]]
    order.sort(key=lambda i: (rounds[i], names[i]))
    while at < len(order):
        end, now = at, rounds[order[at]]
        chosen: dict = {}
        while end < len(order) and rounds[order[end]] == now:
            if names[order[end]] not in chosen:
                chosen[names[order[end]]] = arms.choose()
            end += 1
        for i in order[at:end]:
            arm = chosen[names[i]]
            arms.weights[arm] = reward(arms.weights[arm], improvements[i], collapses[i], bool(failures[i]))
            rows.append((int(now), names[i], arm, round(arms.weights[arm], 9)))
        at = end
    return rows


def allocate(part: pd.DataFrame, arms: Arms, order: str, worker: str | None) -> list[tuple[int, object, int, float]]:
    """allocated() over the rows of a frame."""
    names = part[worker].tolist() if worker else [0] * len(part)
    return allocated(part[order].tolist(), names, *(part[c].tolist() for c in OBSERVED), arms)


def allocation_trace(observations: DataFrame, bundle: str, priorities: list[float], order: str = "round_index", worker: str | None = None, most: int = 1_000_000) -> DataFrame:
    """Upper-confidence allocation of evidence branches per bundle, each observation rewarding the arm that was chosen.

    priorities are the arms' first weights. With a worker column several workers share one state. A
    bundle of more than ``most`` observations is an error. failed is a column of the observations.
    """
    ship_package(observations.sparkSession)
    keys = [bundle, order, *([worker] if worker else [])]
    needed = observations.select(*keys, F.col("objective_improvement"), F.coalesce("structural_collapse_rate", F.lit(float("nan"))).alias("structural_collapse_rate"), "failed")

    def fold(part: pa.Table) -> pa.Table:
        if part.num_rows > most:
            raise ValueError(f"a bundle has more than {most} observations")
        names = part[worker].to_pylist() if worker else [0] * part.num_rows
        found = allocated(part[order].to_pylist(), names, *(part[c].to_pylist() for c in OBSERVED), Arms(list(priorities), [0] * len(priorities)))
        at, by, arm, weight = zip(*found, strict=True) if found else ((), (), (), ())
        columns = {bundle: pa.array(part[bundle][:1].to_pylist() * len(at), part.schema.field(bundle).type), order: pa.array(at, pa.int64())}
        if worker:
            columns[worker] = pa.array(by, part.schema.field(worker).type)
        return pa.table({**columns, "arm": pa.array(arm, pa.int32()), "weight": pa.array(weight, pa.float64())})

    of = lambda c: f"{c} {observations.schema[c].dataType.simpleString()}"
    schema = ", ".join([of(bundle), f"{order} long", *([of(worker)] if worker else []), "arm int", "weight double"])
    return needed.groupBy(bundle).applyInArrow(fold, schema)


def trend(observations: DataFrame, branch: str, order: str, improvement: str, collapse: str, limits: Limits = Limits()) -> DataFrame:
    """Whether the last improvements are all above the tolerance or all within it of zero, whether collapse grew, and the previous collapse rate."""
    by = Window.partitionBy(branch).orderBy(order)
    last = by.rowsBetween(-(limits.history - 1), 0)
    full = F.count(improvement).over(last) == limits.history
    before = F.lag(collapse).over(by)
    sustained = full & (F.min(improvement).over(last) > limits.improvement_epsilon)
    stagnant = full & (F.max(F.abs(improvement)).over(last) <= limits.improvement_epsilon)
    grew = F.coalesce(F.col(collapse) > before + limits.collapse_epsilon, F.lit(False))
    return observations.select(branch, order, sustained.alias("sustained"), stagnant.alias("stagnant"), grew.alias("collapse_increased"), before.alias("previous_collapse"))


def _cover_of_two(points: DataFrame, sizes: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    """cover() on two axes: points are distinct and dealt into blocks of large sets."""
    steps = points.select(*key, order).distinct().withColumn("_before", F.lag(order).over(Window.partitionBy(*key).orderBy(order)))
    if not sizes.where("_blocks > 1").isEmpty():
        earlier = Window.partitionBy(*key, order, "_block").orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
        above = points.repartition(*key, order, "_block").withColumn("_above", F.max(y).over(earlier))
        points = above.where(F.col("_above").isNull() | (F.col("_above") < F.col(y))).drop("_above")
    own = points.select(*key, order, x, y, F.lit(True).alias("_new"))
    after = steps.where("_before is not null").select(*key, F.col(order).alias("_next"), F.col("_before").alias(order))
    old = points.join(after, [*key, order]).select(*key, F.col("_next").alias(order), x, y, F.lit(False).alias("_new"))
    upto = Window.partitionBy(*key, order).orderBy(F.desc(x))  # with the rows of an equal first value
    best = lambda new: F.max(F.when(F.col("_new") == new, F.col(y))).over(upto)
    met = own.unionByName(old).withColumn("_best", F.when(F.col("_new"), best(False)).otherwise(best(True)))
    covered = F.coalesce(F.col("_best") >= F.col(y), F.lit(False)).cast("int")
    of = met.groupBy(*key, order).agg(F.min(F.when(~F.col("_new"), covered)).alias("_up"), F.min(F.when(F.col("_new"), covered)).alias("_down"))
    return of.select(*key, order, (F.col("_up") - F.col("_down")).cast("long").alias("improvement"))


def cover(rows: DataFrame, key: list[str], order: str, axes: list[str]) -> DataFrame:
    """key, order and improvement of each set over the one before: +1 if it covers that one and isn't covered by it, -1 the other way round, else 0.

    A set covers another if for each member of that one it has a member at least as good on all (maximised)
    axes. On one axis the best members decide. On two, the greatest second value among the other set's
    members that are at least as good on the first says whether a member is covered: a running maximum,
    after sets of more than BLOCK members are reduced in blocks. On more, both sets are first reduced to the members that
    no other one covers, by a pass over blocks and one over what they leave. The first set has null.
    """
    before = F.lag(order).over(Window.partitionBy(*key).orderBy(order))
    if len(axes) == 1:
        best = rows.groupBy(*key, order).agg(F.max(axes[0]).alias("best"))
        last = F.lag("best").over(Window.partitionBy(*key).orderBy(order))
        return best.select(*key, order, F.signum(F.col("best") - last).cast("long").alias("improvement"))
    points = rows.select(*key, order, *axes).dropna(subset=axes).distinct()
    if len(axes) == 2:
        points = materialize(points, "points")
    sizes = points.groupBy(*key, order).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_blocks"))
    points = points.join(sizes, [*key, order]).withColumn("_block", F.pmod(F.xxhash64(*axes), F.col("_blocks"))).drop("_blocks")
    if len(axes) == 2:
        return _cover_of_two(points, sizes, key, order, *axes)

    def tops(part: pd.DataFrame) -> pd.DataFrame:
        x = part[axes].to_numpy(float)
        kept: list[int] = []
        for i in np.lexsort(x.T[::-1])[::-1]:
            if not (kept and (x[kept] >= x[i]).all(1).any()):
                kept.append(i)
        return part.iloc[sorted(kept)]

    edge = points.groupBy(*key, order, "_block").applyInPandas(tops, points.schema).withColumn("_block", F.lit(0).cast("long"))
    if not sizes.where("_blocks > 1").isEmpty():
        edge = edge.groupBy(*key, order).applyInPandas(tops, edge.schema)
    edge = edge.drop("_block")
    steps = points.select(*key, order).distinct().withColumn("_before", before)
    side = lambda name, as_: edge.select(*key, F.col(order).alias(name), F.struct(*axes).alias(as_))
    now, old = steps.join(side(order, "_new"), [*key, order]), side("_before", "_old")
    pairs = now.join(old, [*key, "_before"])
    new_wins = reduce(and_, [F.col(f"_new.{a}") >= F.col(f"_old.{a}") for a in axes])
    old_wins = reduce(and_, [F.col(f"_old.{a}") >= F.col(f"_new.{a}") for a in axes])
    of_old = pairs.groupBy(*key, order, "_old").agg(F.max(new_wins.cast("int")).alias("_c")).groupBy(*key, order).agg(F.min("_c").alias("_up"))
    of_new = pairs.groupBy(*key, order, "_new").agg(F.max(old_wins.cast("int")).alias("_c")).groupBy(*key, order).agg(F.min("_c").alias("_down"))
    out = steps.join(of_old, [*key, order], "left").join(of_new, [*key, order], "left")
    return out.select(*key, order, F.when(F.col("_before").isNotNull(), F.col("_up") - F.col("_down")).cast("long").alias("improvement"))
