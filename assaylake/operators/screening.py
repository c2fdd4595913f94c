"""Two-model screening: aligned pairs, composition-relative energies, risk classes, Pareto fronts, crowding, portfolios."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import reasons
from assaylake.operators.fronts import all_fronts
from assaylake.session import materialize

BLOCK = 2048  # rows of a group that one task compares with each other


def pair_experts(rows: DataFrame, entity: str, value: str, first: str, second: str) -> DataFrame:
    """One row per entity with both experts' values; an expert without exactly one row is a reason."""
    one = lambda e, name: F.sum((F.col("expert_id") == e).cast("int")).alias(name)
    of = lambda e, name: F.max(F.when(F.col("expert_id") == e, F.col(value))).alias(name)
    out = rows.groupBy(entity).agg(one(first, "n1"), one(second, "n2"), of(first, "first_value"), of(second, "second_value"))
    why = reasons(first_not_exactly_one=F.col("n1") != 1, second_not_exactly_one=F.col("n2") != 1)
    good = (F.col("n1") == 1) & (F.col("n2") == 1)
    return out.select(entity, F.when(good, F.col("first_value")).alias("first_value"), F.when(good, F.col("second_value")).alias("second_value"), why.alias("reasons"))


def relative_energy(rows: DataFrame, entity: str, group: str, first: str, second: str, alignment: str) -> DataFrame:
    """Energies less the group's least one, competition ranks and their differences.

    A group of one, without alignment in some row or with several alignments is unknown and escalates.
    """
    w = Window.partitionBy(group)
    size, missing = F.count("*").over(w), F.sum(F.col(alignment).isNull().cast("int")).over(w)
    several = F.min(alignment).over(w) != F.max(alignment).over(w)
    out = rows.withColumn("pool_size", size).withColumn("reasons", reasons(singleton_composition_pool=size < 2, energy_pair_alignment_missing=missing > 0, energy_pair_alignment_inconsistent=(missing == 0) & F.coalesce(several, F.lit(False))))
    known = F.size("reasons") == 0
    for name, column in (("first", first), ("second", second)):
        out = out.withColumn(f"{name}_relative", F.when(known, F.col(column) - F.min(column).over(w)))
        out = out.withColumn(f"{name}_rank", F.when(known, F.rank().over(Window.partitionBy(group).orderBy(column))))
    return out.select(
        entity, group, "pool_size", "reasons", F.when(known, "available").otherwise("unknown").alias("status"),
        F.abs(F.col("first_relative") - F.col("second_relative")).alias("energy_difference"),
        F.abs(F.col("first_rank") - F.col("second_rank")).cast("long").alias("rank_difference"), (~known).alias("escalate"),
    )


def risk_class(measures: dict[str, tuple[Column, float, float]], required: dict[str, Column]) -> Column:
    """(risk, escalate, reasons): the worst of measures against (medium, high) thresholds; what is required and missing is high."""
    missing = reasons(**required)
    above = lambda k: reduce(or_, [F.coalesce(m[0] >= m[k], F.lit(False)) for m in measures.values()])
    high = above(2) | (F.size(missing) > 0)
    return F.struct(F.when(high, "high").when(above(1), "medium").otherwise("low").alias("risk"), high.alias("escalate"), missing.alias("reasons"))


def dominates(axes: list[str], left: str, right: str) -> Column:
    """All axes of left at most right's and one below (all minimised)."""
    at_most = reduce(and_, [F.col(f"{left}.{a}") <= F.col(f"{right}.{a}") for a in axes])
    below = reduce(or_, [F.col(f"{left}.{a}") < F.col(f"{right}.{a}") for a in axes])
    return at_most & below


def _local_skyline(axes: list[str]):
    def keep(part: pd.DataFrame) -> pd.DataFrame:
        x = part[axes].to_numpy(float)
        order = np.lexsort(x.T[::-1])
        front: list[int] = []
        for i in order:
            f = x[front] if front else np.empty((0, len(axes)))
            if not ((f <= x[i]).all(1) & (f < x[i]).any(1)).any():
                front.append(i)
        return part.iloc[sorted(front)]

    return keep


def non_dominated(rows: DataFrame, entity: str, group: str, axes: list[str]) -> DataFrame:
    """The rows of each group that no other row of it dominates.

    Dominance is transitive: blocks of bounded size drop what they dominate inside, and only the
    blocks' survivors meet in the join.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_blocks"))
    blocked = rows.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(entity), F.col("_blocks"))).drop("_blocks")
    left = blocked.groupBy(group, "_block").applyInPandas(_local_skyline(axes), blocked.schema).drop("_block")
    left = materialize(left, "skyline")
    return left.alias("a").join(left.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & dominates(axes, "b", "a"), "left_anti")


def pareto_fronts(rows: DataFrame, entity: str, group: str, axes: list[str]) -> DataFrame:
    """(entity, front): 1 for the non-dominated rows of each group (less is better), 2 for those without them, and so on.

    Rows with a null axis have no front. See fronts.all_fronts for groups of any size.
    """
    return all_fronts(rows, entity, group, [(-F.col(a), -F.col(a)) for a in axes])


def crowding(rows: DataFrame, entity: str, by: list[str], axes: list[str]) -> DataFrame:
    """rows with boundary and crowding: scaled gaps between neighbours, summed over the axes.

    Ends of an axis are boundaries, a constant axis doesn't count, and groups of at most two are all boundary.
    """
    group = Window.partitionBy(*by)
    small = F.count("*").over(group) <= 2
    boundary, distance = F.lit(False), F.lit(0.0)
    out = rows
    for i, a in enumerate(axes):
        w = Window.partitionBy(*by).orderBy(a, entity)
        low, high = F.min(a).over(group), F.max(a).over(group)
        before, after = F.lag(a).over(w), F.lead(a).over(w)
        varies = (high - low) > 1e-15
        out = out.withColumn(f"_e{i}", varies & (before.isNull() | after.isNull())).withColumn(f"_d{i}", F.when(varies & before.isNotNull() & after.isNotNull(), (after - before) / (high - low)).otherwise(0.0))
        boundary, distance = boundary | F.col(f"_e{i}"), distance + F.col(f"_d{i}")
    out = out.withColumn("_small", small).withColumn("boundary", F.col("_small") | boundary).withColumn("crowding", F.when(F.col("_small"), 0.0).otherwise(distance))
    return out.drop("_small", *[f"_{k}{i}" for k in "ed" for i in range(len(axes))])


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in a total order: a range sort, then each partition's offset; no single-task window."""
    placed = rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialize(placed, "ranked")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row a partition
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def portfolio(ranked: DataFrame, entity: str, group: str, top_k: int) -> DataFrame:
    """(entity, slot): the best of each group first, then the next best; one escalated row gets the last slot if none is in.

    ranked has rank, eligible and escalate.
    """
    if not 1 <= top_k <= 5:
        raise ValueError("top_k must be between 1 and 5")
    usable = ranked.where("eligible").select(entity, group, "rank", "escalate")
    first = usable.groupBy(group).agg(F.min("rank").alias("rank")).select("rank", F.lit(0).alias("tier"))
    tiered = usable.join(first, "rank", "left").withColumn("tier", F.coalesce("tier", F.lit(1)))
    chosen = tiered.orderBy("tier", "rank").limit(top_k).withColumn("slot", F.row_number().over(Window.orderBy("tier", "rank")).cast("long"))
    reserve = usable.where("escalate").orderBy("rank").limit(1).select(entity, F.lit(True).alias("escalate"))
    state = chosen.agg(F.coalesce(F.max(F.col("escalate").cast("int")), F.lit(0)).alias("has"), F.count("*").alias("n"))
    extra = reserve.join(state.where("has = 0"), F.lit(True)).select(entity, F.least(F.col("n") + 1, F.lit(top_k)).cast("long").alias("slot"))
    kept = chosen.select(entity, "slot").join(extra.select(F.col("slot").alias("_s")), F.col("slot") == F.col("_s"), "left_anti")
    return kept.unionByName(extra)
