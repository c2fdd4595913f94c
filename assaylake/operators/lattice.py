"""Pairs of cells with near lattice parameters: a tolerance join over a grid, hot grid cells split."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.session import materialize

LENGTHS, ANGLES = ["a", "b", "c"], ["alpha", "beta", "gamma"]
PARAMETERS = [*LENGTHS, *ANGLES, "volume"]  # the volume is that of an atom
STRICT_LENGTH, STRICT_ANGLE, SCALED_LENGTH, SCALED_ANGLE, VOLUME = 0.02, 1.0, 0.2, 5.0, 0.03
CELL_ROWS = 512  # rows of a grid cell that meet its neighbours in one task

# A gap of g (of the mean) is a ratio of at most (2 + g) / (2 - g): the side of a cell of logarithms.
SIDE = "ln((2 + 0.2D) / (2 - 0.2D)) * 1.000001D"


def _gap(x: str, y: str) -> str:
    return f"(abs({x} - {y}) / (({x} + {y}) / 2))"


def relation_sql(left: str, right: str) -> str:
    """SQL of the relation of two rows with the columns PARAMETERS, each with a prefix.

    strict: lengths within 2 %, angles within 1 degree, volume an atom within 3 %. scaled: the same
    lattice but for its size, with lengths over the cube root of the volume within 20 % and angles
    within 5 degrees; ambiguous: nothing known rules that out, but a parameter is missing.
    """
    size = lambda side, x: f"({side}{x} / cbrt({side}volume))"
    strict = [f"{_gap(left + x, right + x)} <= {STRICT_LENGTH}" for x in LENGTHS] + [f"abs({left}{x} - {right}{x}) <= {STRICT_ANGLE}" for x in ANGLES] + [f"{_gap(left + 'volume', right + 'volume')} <= {VOLUME}"]
    scaled = [f"{_gap(size(left, x), size(right, x))} <= {SCALED_LENGTH}" for x in LENGTHS] + [f"abs({left}{x} - {right}{x}) <= {SCALED_ANGLE}" for x in ANGLES]
    known = " AND ".join(f"{s}{x} IS NOT NULL" for s in (left, right) for x in PARAMETERS)
    possible = " AND ".join(f"coalesce({c}, true)" for c in scaled)
    return f"CASE WHEN NOT ({possible}) THEN 'distinct' WHEN NOT ({known}) THEN 'ambiguous' WHEN {' AND '.join(strict)} THEN 'strict' ELSE 'scaled' END"


def near_lattices(rows: DataFrame, entity: str, block: str) -> tuple[DataFrame, DataFrame]:
    """Classes of rows of equal parameters, and the related pairs of classes.

    The first is (entity, class): class is the least entity of its block with the same parameters. The
    second is (left, right, relation, n_pairs) for left < right, or left = right for the pairs inside a class, that are strict, scaled or ambiguous;
    n_pairs counts the pairs of rows that a pair of classes stands for. Lengths and volumes must be
    positive (others are taken as missing). Rows of a null block are one block; an empty table gives
    empty results. A row with a missing parameter that the grid goes by is in all its cells on that axis.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    values = [positive(c).alias(c) for c in (*LENGTHS, "volume")] + [F.col(c).cast("double").alias(c) for c in ANGLES]
    plain = rows.select(F.col(entity).alias("_e"), F.struct(F.col(block).alias("b")).alias("_b"), *values)
    same = ["_b", *PARAMETERS]
    classes = materialize(plain.groupBy(*same).agg(F.min("_e").alias("_c"), F.count("*").alias("_n")), "classes")
    null_safe = [plain[c].eqNullSafe(classes[c]) for c in PARAMETERS]
    condition = plain["_b"] == classes["_b"]
    for c in null_safe:
        condition &= c
    members = plain.join(classes, condition).select(plain["_e"].alias(entity), F.col("_c").alias("class"))

    scaled = lambda c: F.floor(F.ln(F.col(c) / F.expr("cbrt(volume)")) / F.expr(SIDE))
    axes = {"_x0": scaled("a"), "_x1": scaled("b"), "_x2": F.floor(F.col("alpha") / SCALED_ANGLE)}
    placed = classes.withColumns(axes)
    ends = placed.groupBy("_b").agg(*[f(F.coalesce(x, F.lit(0))).alias(f"{x}{n}") for x in axes for f, n in ((F.min, "low"), (F.max, "high"))])
    placed = placed.join(ends, "_b")
    for x in axes:
        every = F.sequence(F.col(f"{x}low"), F.col(f"{x}high"))
        placed = placed.withColumn(x, F.explode(F.when(F.col(x).isNull(), every).otherwise(F.array(x)))).drop(f"{x}low", f"{x}high")
    placed = materialize(placed, "placed")

    cell = ["_b", *axes]
    parts = placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("_parts"))
    left = placed.join(parts, cell).withColumn("_part", F.pmod(F.xxhash64("_c"), F.col("_parts")).cast("int")).drop("_parts")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=len(axes))])
    around = placed.withColumn("_s", F.explode(steps))
    around = around.withColumns({x: F.col(x) + F.col("_s")[i] for i, x in enumerate(axes)}).drop("_s")
    # Rows around a cell go to each of its parts.
    around = around.join(parts, cell).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = around.select(*cell, "_part", *[F.col(c).alias(f"r_{c}") for c in ("_c", "_n", *PARAMETERS)])
    pairs = left.join(right, [*cell, "_part"]).where("_c < r__c").withColumn("relation", F.expr(relation_sql("", "r_")))
    related = pairs.where("relation <> 'distinct'").select(F.col("_c").alias("left"), F.col("r__c").alias("right"), "relation", (F.col("_n") * F.col("r__n")).alias("n_pairs"))
    inside = classes.where("_n > 1").select(*[F.col(c) for c in ("_c", "_n", *PARAMETERS)])
    twice = inside.withColumns({f"r_{c}": F.col(c) for c in PARAMETERS}).withColumn("relation", F.expr(relation_sql("", "r_")))
    own = twice.select(F.col("_c").alias("left"), F.col("_c").alias("right"), "relation", F.expr("_n * (_n - 1) div 2").alias("n_pairs"))
    return members, related.distinct().unionByName(own)
