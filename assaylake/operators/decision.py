"""Condition-scoped decisions: criterion status, gates, comparable groups, robust fronts, pool scores, claim ladders."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.fronts import all_fronts
from assaylake.session import materialize

FRONT_BLOCK = 1 << 16  # rows of a group that are reduced at once before its fronts are counted


def criterion_status(rows: DataFrame, keys: list[str], condition: str, value: str, low: str, high: str, validator: str) -> DataFrame:
    """Per key available, conflicting (several values) or incomparable (several condition sets); nothing is averaged.

    Only one agreed (value, bounds) triple gives a value; the validators stay listed in every case.
    """
    triple = F.struct(value, low, high)
    same = rows.groupBy(*keys).agg(F.min(condition).alias("c1"), F.max(condition).alias("c2"), F.min(triple).alias("t1"), F.max(triple).alias("t2"), F.array_sort(F.collect_set(validator)).alias("validators"), F.count("*").alias("n_observations"))
    status = F.when(F.col("c1") != F.col("c2"), "incomparable").when(F.col("t1") != F.col("t2"), "conflicting").otherwise("available")
    one = lambda c: F.when(F.col("status") == "available", F.col(f"t1.{c}")).alias(c)
    return same.withColumn("status", status).select(*keys, "status", one(value), one(low), one(high), F.when(F.col("status") != "incomparable", F.col("c1")).alias(condition), "validators", "n_observations")


def gate_rollup(gates: DataFrame, keys: list[str], gate: str = "gate") -> DataFrame:
    """fail before unknown before pass before not_configured."""
    has = lambda v: F.max((F.col(gate) == v).cast("int")) == 1
    return gates.groupBy(*keys).agg(F.when(has("fail"), "fail").when(has("unknown"), "unknown").when(has("pass"), "pass").otherwise("not_configured").alias("hard_gate"))


def condition_groups(rows: DataFrame, keys: list[str], signature: list[Column]) -> DataFrame:
    """Key of comparability of each entity: the hash of its criteria's signatures in order, as a JSON list of JSON lists."""
    each = F.to_json(F.array(*[s.cast("string") for s in signature]))
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(each))), 256).alias("group_id"), F.count("*").alias("n_criteria"))


def front_levels(rows: DataFrame, group: str, worst: str, best: str) -> DataFrame:
    """(group, level): the greatest worst value of each front on one axis, front after front.

    A level is the greatest worst value among the rows whose best lies below the level before. Only
    rows with a worst value above that of every row with a lesser best can be a level: these are found
    per block of a group first, and one pass over what is left of all blocks gives the levels.
    """

    def steps(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        low, high = part[worst].to_numpy(), part[best].to_numpy()
        order = np.lexsort((-low, high))
        low, high = np.maximum.accumulate(low[order]), high[order]
        rise = np.concatenate([[True], low[1:] > low[:-1]])
        return low[rise], high[rise]

    def stairs(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        low, high = steps(part)
        return pa.table({group: pa.array([key[0].as_py()] * len(low), part.schema.field(group).type), worst: low, best: high})

    def descend(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        low, high = steps(part)
        levels, at = [], len(low)
        while at > 0:
            levels.append(low[at - 1])
            at = int(np.searchsorted(high, levels[-1], side="left"))
        return pa.table({group: pa.array([key[0].as_py()] * len(levels), part.schema.field(group).type), "level": pa.array(levels, pa.float64())})

    kind = rows.schema[group].dataType.simpleString()
    ends = rows.select(group, F.col(worst).cast("double").alias(worst), F.col(best).cast("double").alias(best))
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(FRONT_BLOCK)).alias("_blocks"))
    large = sizes.where("_blocks > 1")
    if large.isEmpty():
        return ends.groupBy(group).applyInArrow(descend, f"`{group}` {kind}, level double")
    blocks = ends.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(worst, best), F.col("_blocks")))
    reduced = blocks.select(group, worst, best, "_block").groupBy(group, "_block").applyInArrow(stairs, f"`{group}` {kind}, `{worst}` double, `{best}` double")
    return reduced.groupBy(group).applyInArrow(descend, f"`{group}` {kind}, level double")


def robust_fronts(rows: DataFrame, entity: str, group: str, axes: list[tuple[str, str]]) -> DataFrame:
    """(entity, front) where a row beats another only if its worst is at least the other's best on all axes and above on one.

    The relation is transitive, so fronts are numbered as ordinary ones are. axes are (worst, best) columns;
    a row with a null one has no front, and a worst above its best is an error. On one axis a row's
    front is one more than the number of its group's levels above its best: a sort inside groups.
    """
    ends = [c for a in axes for c in a]
    known = materialize(rows.select(entity, group, *ends).dropna(subset=ends), "ends")  # read four times below
    if not known.where(reduce(or_, [F.col(w) > F.col(h) for w, h in axes])).isEmpty():
        raise ValueError("the worst value of a row is above its best")
    if len(axes) == 1:
        worst, best = axes[0]
        levels = front_levels(known, group, worst, best).select(F.lit(None).cast(known.schema[entity].dataType).alias(entity), group, F.col("level").alias("_value"), F.lit(1).alias("_level"))
        both = known.select(entity, group, F.col(best).cast("double").alias("_value"), F.lit(0).alias("_level")).union(levels)
        above = Window.partitionBy(group).orderBy(F.desc("_value"), "_level").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("front", (F.sum("_level").over(above) + 1).cast("long")).where("_level = 0").select(entity, "front")
    return all_fronts(known, entity, group, [(F.col(w), F.col(h)) for w, h in axes])


def pool_scores(rows: DataFrame, entity: str, group: str, worst: str, weight: str) -> DataFrame:
    """0 to 100 by weighted worst-case utility inside a group; a group of one has no score, a constant criterion counts half.

    Extremes and sizes are aggregates with partial sums that are joined back, so a large group isn't one task.
    """
    low, high = F.col("_low"), F.col("_high")
    ends = rows.groupBy(group, "criterion_id").agg(F.min(worst).alias("_low"), F.max(worst).alias("_high"))
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    part = rows.join(ends, [group, "criterion_id"]).withColumn("_p", F.when(flat, F.lit(0.5)).otherwise((F.col(worst) - low) / (high - low)))
    total = part.groupBy(group, entity).agg((100 * F.sum(F.col("_p") * F.col(weight)) / F.sum(weight)).alias("score"))
    size = total.groupBy(group).agg(F.count("*").alias("_n"))
    return total.join(size, group).withColumn("score", F.when(F.col("_n") >= 2, F.col("score"))).drop("_n")


def completeness(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Share of available criteria in percent, and ready when all are."""
    ok = F.col(status) == "available"
    return rows.groupBy(*keys).agg((100.0 * F.sum(ok.cast("int")) / F.count("*")).alias("completeness"), F.min(ok.cast("int")).alias("_r"), F.count("*").alias("n_criteria")).withColumn("ready", F.col("_r") == 1).drop("_r")


def requirement_decision(records: DataFrame, keys: list[str], met: str, source: str, min_records: int, min_sources: int) -> DataFrame:
    """passed, failed, conflict or insufficient: enough records and independent sources that meet the criterion, none against.

    Records without a source count for none.
    """
    yes, no = F.col(met), ~F.col(met)
    out = records.groupBy(*keys).agg(F.sum(yes.cast("int")).cast("long").alias("n_for"), F.sum(no.cast("int")).cast("long").alias("n_against"), F.countDistinct(F.when(yes, F.col(source))).alias("n_sources"))
    n_for, n_against = F.coalesce("n_for", F.lit(0)), F.coalesce("n_against", F.lit(0))
    decision = F.when((n_for > 0) & (n_against > 0), "conflict").when((n_for >= min_records) & (F.col("n_sources") >= min_sources), "passed").when(n_against > 0, "failed").otherwise("insufficient")
    return out.withColumn("n_for", n_for).withColumn("n_against", n_against).withColumn("decision", decision)


def gate_decision(requirements: DataFrame, keys: list[str]) -> DataFrame:
    """passed if all requirements are; insufficient if one conflicts or lacks evidence, else failed."""
    has = lambda v: F.max((F.col("decision") == v).cast("int")) == 1
    return requirements.groupBy(*keys).agg(F.when(has("conflict") | has("insufficient"), "insufficient").when(has("failed"), "failed").otherwise("passed").alias("gate"))


def claim_ladder(gates: DataFrame, entity: str, level: str = "level", gate: str = "gate") -> DataFrame:
    """Highest level up to which every gate passes (0: none); rejected if one fails."""
    w = Window.partitionBy(entity).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    upto = gates.withColumn("_ok", F.min((F.col(gate) == "passed").cast("int")).over(w))
    out = upto.groupBy(entity).agg(F.coalesce(F.max(F.when(F.col("_ok") == 1, F.col(level))), F.lit(0)).cast("long").alias("claim_level"), F.max((F.col(gate) == "failed").cast("int")).alias("_f"))
    return out.withColumn("status", F.when(F.col("_f") == 1, "rejected").when(F.col("claim_level") > 0, "supported").otherwise("unproven")).drop("_f")


