"""Greedy leader groups without a whole block in one task: rounds over neighbouring cells.

In the order of the ids a row joins the first leader that it equals within tolerance, or else leads. A
row's fate depends on earlier rows near it alone, so rows are dealt into cells of the tolerance's side
by a few components, and each round a task per cell sees the first undecided rows of the cell and of
those around it: a row near a sure leader is covered, and a row of the cell whose earlier near rows
are all covered leads. New leaders then cover what is near them by a join. The result equals the
one-by-one loop.

A component that is null makes a comparison undecidable unless a known component rules it out: such a
pair is ambiguous, is listed and is never merged, so a row with a null component leads its own group.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import Scratch, materialize, ship_package

FIRST = 1024  # undecided rows of a cell that a round looks at


def _within(left: Column, right: Column, tolerance: float) -> Column:
    """Whether all components known on both sides are within tolerance."""
    return F.forall(F.zip_with(left, right, lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))), lambda x: x)


def _around(rows: DataFrame, axes: int) -> DataFrame:
    """rows with _n0.. for each cell around theirs."""
    steps = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=axes)])
    out = rows.withColumn("_step", F.explode(steps))
    return out.withColumns({f"_n{k}": F.col(f"_c{k}") + F.col("_step")[k] for k in range(axes)}).drop("_step")


def _deciding(axes: int, tolerance: float):
    """A function of a cell's table: the rows that lead for sure."""

    def decide(part: pa.Table) -> pa.Table:
        part = part.sort_by("_id")
        ends = part["_end"].drop_null()
        last = min(ends.to_pylist()) if len(ends) else None
        ids = part["_id"].to_pylist()
        own = np.all([part[f"_c{k}"].to_numpy() == part[f"_n{k}"].to_numpy() for k in range(axes)], axis=0)
        x = np.stack(part["_v"].to_numpy()).astype(float)
        sure, unknown, found = np.zeros_like(x), np.zeros_like(x), []
        n_sure = n_unknown = 0
        for i in range(len(x)):
            if last is not None and ids[i] > last:  # rows beyond are not all in sight
                break
            if (np.abs(sure[:n_sure] - x[i]).max(1, initial=0) <= tolerance).any():
                continue
            if own[i] and not (np.abs(unknown[:n_unknown] - x[i]).max(1, initial=0) <= tolerance).any():
                sure[n_sure] = x[i]
                n_sure += 1
                found.append(i)
            else:
                unknown[n_unknown] = x[i]
                n_unknown += 1
        return part.take(pa.array(found, pa.int64())).select(["_b", "_id", "_v", *(f"_c{k}" for k in range(axes))])

    return decide


def _leaders(rows: DataFrame, axes: int, tolerance: float) -> DataFrame:
    """Rows (_b, _id, _v, _c0..) without null components that lead."""
    cell = ["_b", *[f"_c{k}" for k in range(axes)]]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("_b", "_id", "_v", *cell[1:]))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_id"))
    rest, found = rows, None
    while not rest.isEmpty():
        counts = rest.groupBy(*cell).agg((F.count("*") > FIRST).alias("_cut"))
        first = rest.withColumn("_place", place).where(F.col("_place") <= FIRST).join(counts, cell)
        # The last row in sight of a cell that goes on bounds what its neighbours can decide.
        first = first.withColumn("_end", F.when(F.col("_cut") & (F.col("_place") == FIRST), F.col("_id")))
        near = _around(first.select(*rows.columns, "_end"), axes)
        new = near.groupBy("_b", *[f"_n{k}" for k in range(axes)]).applyInArrow(_deciding(axes, tolerance), schema)
        new = materialize(new, "leaders")
        found = new if found is None else found.unionByName(new)
        reach = _around(new, axes).select("_b", F.col("_v").alias("_w"), *[F.col(f"_n{k}").alias(f"_c{k}") for k in range(axes)])
        a, b = rest.alias("a"), reach.alias("b")
        same = F.col("a._b") == F.col("b._b")
        for k in range(axes):
            same &= F.col(f"a._c{k}") == F.col(f"b._c{k}")
        rest = materialize(a.join(b, same & _within(F.col("a._v"), F.col("b._w"), tolerance), "left_anti"), "undecided")
    return rows.limit(0) if found is None else found


def leader_groups(rows: DataFrame, block: str, entity: str, vector: str, tolerance: float, axes: tuple[int, ...] = (0, 1)) -> tuple[DataFrame, DataFrame]:
    """(entity, leader) for every row, and (leader, entity) of ambiguous comparisons that the loop would meet.

    Rows are compared inside blocks (rows of a null block are one) and in the order of entity, which
    tells rows apart. axes are the components that make cells, at most three. A row whose vector is
    null, or has a null component, leads itself; a null vector is compared with nothing. An ambiguous
    comparison is listed for leaders before the one that a row joins. An empty table gives empty results.
    """
    ship_package(rows.sparkSession)
    k = len(axes)
    values = F.transform(vector, lambda x: x.cast("double"))
    plain = rows.select(F.struct(F.col(block).alias("b")).alias("_b"), F.col(entity).alias("_id"), values.alias("_v"))
    cells = {f"_c{i}": F.floor(F.get("_v", F.lit(a)) / tolerance).cast("long") for i, a in enumerate(axes)}
    with Scratch() as scratch:
        known = F.coalesce(~F.exists("_v", lambda x: x.isNull() | F.isnan(x)) & (F.size("_v") > max(axes)), F.lit(False))
        placed = materialize(plain.withColumns(cells).withColumn("_known", known), "placed")
        whole = placed.where("_known").drop("_known")
        keys = ["_b", "_v", *[f"_c{i}" for i in range(k)]]
        different = materialize(whole.groupBy(*keys).agg(F.min("_id").alias("_id")).select("_b", "_id", "_v", *keys[2:]), "different")
        leaders = materialize(_leaders(different, k, tolerance), "leaders")
        reach = _around(leaders, k).select("_b", F.col("_id").alias("_leader"), F.col("_v").alias("_w"), *[F.col(f"_n{i}").alias(f"_c{i}") for i in range(k)])
        joined = different.join(reach, ["_b", *keys[2:]]).where(_within(F.col("_v"), F.col("_w"), tolerance))
        of = joined.groupBy("_b", "_v").agg(F.min("_leader").alias("_leader"))
        grouped = whole.join(of, ["_b", "_v"]).select("_b", "_id", "_v", *keys[2:], "_leader").unionByName(placed.where("not _known").drop("_known").withColumn("_leader", F.col("_id")))
        grouped = scratch.keep(materialize(grouped, "grouped"))
        pairs = scratch.keep(materialize(_ambiguous(grouped, k, tolerance), "ambiguous"))
    return grouped.select(F.col("_id").alias(entity), F.col("_leader").alias("leader")), pairs.select(F.col("_leader").alias("leader"), F.col("_id").alias(entity))


def _ambiguous(grouped: DataFrame, axes: int, tolerance: float) -> DataFrame:
    """Pairs of a leader and a later row where one has a null component and nothing known rules them out.

    A row with a null component on an axis of the cells is in all cells of its block on that axis.
    """
    rows = grouped.where("_v is not null").withColumn("_known", ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))
    ends = rows.groupBy("_b").agg(*[f(F.coalesce(f"_c{i}", F.lit(0))).alias(f"_{n}{i}") for i in range(axes) for f, n in ((F.min, "low"), (F.max, "high"))])

    def spread(part: DataFrame) -> DataFrame:
        out = part.join(ends, "_b")
        for i in range(axes):
            cells = F.when(F.col(f"_c{i}").isNull(), F.sequence(F.col(f"_low{i}"), F.col(f"_high{i}"))).otherwise(F.array(f"_c{i}"))
            out = out.withColumn(f"_c{i}", F.explode(cells))
        return out.drop(*[f"_{n}{i}" for i in range(axes) for n in ("low", "high")])

    lead = _around(spread(rows.where("_id = _leader")), axes).select("_b", F.col("_id").alias("_l"), F.col("_v").alias("_w"), F.col("_known").alias("_sure"), *[F.col(f"_n{i}").alias(f"_c{i}") for i in range(axes)]).distinct()
    cell = ["_b", *[f"_c{i}" for i in range(axes)]]
    # Either side has a null: two joins, so that complete rows never meet complete leaders here.
    one = spread(rows).join(lead.where("not _sure"), cell)
    other = spread(rows.where("not _known")).join(lead.where("_sure"), cell)
    met = one.select("_id", "_leader", "_v", "_l", "_w").unionByName(other.select("_id", "_leader", "_v", "_l", "_w"))
    # A row that joins a leader isn't compared with later ones; one that leads is compared with all before it.
    before = F.col("_l") < F.least("_leader", "_id")
    return met.where(before & _within(F.col("_v"), F.col("_w"), tolerance)).select(F.col("_l").alias("_leader"), "_id").distinct()
