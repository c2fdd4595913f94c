"""Branch selection: eligibility, mixed-axis first front, diversity, disagreement, top-k, rank fusion, shortlists, calibration."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import reasons

# Branch weights and the constant of reciprocal-rank fusion.
BRANCH_WEIGHTS = {"pareto": 1.25, "stability": 1.0, "target": 1.0, "diversity": 0.45, "disagreement": 0.25}
FUSION_K = 20


def common_dimensions(rows: DataFrame, entity: str, dimension: list[str]) -> DataFrame:
    """Entities that have every dimension seen in the pool."""
    seen = rows.select(entity, F.struct(*dimension).alias("d")).distinct()
    wanted = seen.select("d").distinct().count()
    return seen.groupBy(entity).agg(F.count("*").alias("n")).where(F.col("n") == wanted).select(entity)


def first_front(rows: DataFrame, entity: str, shared: list[str], scoped: list[str], scope: str) -> DataFrame:
    """Rows that no other row dominates; scoped axes count only between rows of one scope (all maximised).

    Across scopes only shared axes are compared, so the relation isn't transitive and nothing may be
    dropped early in general. Inside a scope it is: blocks drop what they dominate inside before the
    survivors meet. On the shared axes alone it is, too: a row that another scope's row dominates
    is found against the distinct points of the shared axes, of which only the undominated ones and
    their scopes matter.
    """
    from assaylake.operators.screening import non_dominated

    better = lambda axes, strict: (reduce(and_, [F.col(f"b.{a}") >= F.col(f"a.{a}") for a in axes]), reduce(or_, [F.col(f"b.{a}") > F.col(f"a.{a}") for a in axes]))[strict]
    least = {f"_least_{a}": -F.col(a) for a in shared + scoped}
    left = non_dominated(rows.withColumns(least), entity, scope, list(least)).drop(*least)
    points = rows.groupBy(*shared).agg(F.min(scope).alias("s1"), F.max(scope).alias("s2"))
    lead = points.orderBy(*[F.desc(a) for a in shared])
    staircase = lead if len(shared) < 2 else points.alias("a").join(points.alias("b"), better(shared, 0) & better(shared, 1) & (F.col("b.s1") != F.col("b.s2")), "left_anti")
    other = (F.col("b.s1") != F.col(f"a.{scope}")) | (F.col("b.s2") != F.col(f"a.{scope}"))
    return left.alias("a").join(staircase.alias("b"), other & better(shared, 0) & better(shared, 1), "left_anti")


def nearest_distance(rows: DataFrame, entity: str, pool: str, axes: list[str]) -> DataFrame:
    """Chebyshev distance to the nearest other row of the pool; a single row has 1; rows with a null axis are left out.

    Equal points are one point: where several rows have it, the distance is 0. Others look for
    neighbours in the cells around their own, in grids that double their width until the nearest one
    lies within a cell's width; no pool is gathered.
    """
    from assaylake.session import Scratch, materialize

    with Scratch() as scratch:
        known = rows.dropna(subset=axes).select(entity, pool, *[F.col(a).cast("double").alias(a) for a in axes])
        points = known.groupBy(pool, *axes).agg(F.count("*").alias("_copies"))
        spans = points.groupBy(pool).agg(*[F.min(a).alias(f"_low_{a}") for a in axes], F.greatest(F.lit(1e-300), *[F.max(a) - F.min(a) for a in axes]).alias("_span"), F.count("*").alias("_n"))
        points = materialize(points.join(spans, pool), "points")
        wait = points.where("_copies = 1 and _n > 1").drop("_copies")
        out = points.select(pool, *axes, F.when(F.col("_copies") > 1, 0.0).when(F.col("_n") == 1, 1.0).alias("_d")).where("_d is not null")
        # Cells start with about one point each; a width of the whole span leaves nothing out.
        rounds = (points.agg(F.max("_n")).first()[0] or 1).bit_length() // len(axes) + 2
        for step in range(rounds, -1, -1):
            width = F.col("_span") / (1 << step)
            cell = lambda a: F.least(F.lit(1 << step), F.floor((F.col(a) - F.col(f"_low_{a}")) / width))  # noqa: B023, E731
            near = points.select(pool, *[F.col(a).alias(f"_o_{a}") for a in axes], *[cell(a).alias(f"_c_{a}") for a in axes])
            asked = wait
            for a in axes:
                asked = asked.withColumn(f"_c_{a}", F.explode(F.sequence(cell(a) - 1, cell(a) + 1)))
            gap = F.greatest(*[F.abs(F.col(a) - F.col(f"_o_{a}")) for a in axes]) if len(axes) > 1 else F.abs(F.col(axes[0]) - F.col(f"_o_{axes[0]}"))
            found = asked.join(near, [pool, *[f"_c_{a}" for a in axes]]).withColumn("_g", gap).where("_g > 0").groupBy(pool, *axes).agg(F.min("_g").alias("_d"), F.first("_span").alias("_s"))
            near_enough = found.where(F.col("_d") <= F.col("_s") / (1 << step)).select(pool, *axes, "_d")
            tried = materialize(wait.join(near_enough, [pool, *axes], "left"), "tried")
            out = out.unionByName(tried.where("_d is not null").select(pool, *axes, "_d"))
            wait = tried.where("_d is null").drop("_d")
            if wait.isEmpty():
                break
        placed = known.join(out, [pool, *axes]).select(entity, F.col("_d").alias("diversity"))
        return scratch.keep(materialize(placed, "nearest"))


def selector_disagreement(rows: DataFrame, entity: str, scope: str, scoped: str) -> DataFrame:
    """Largest span of normalised values over properties; a scoped property counts only in panels of two or more.

    Without a comparable property the score is null and the reasons say why.
    """
    spans = rows.groupBy(entity, scope, "property_name").agg((F.max("normalized") - F.min("normalized")).alias("span"), F.countDistinct("expert_id").alias("experts"))
    panels = spans.where(F.col("property_name") == scoped).groupBy(scope).agg(F.countDistinct(entity).alias("members"))
    both = spans.join(panels, scope, "left")
    single = (F.col("property_name") == scoped) & (F.coalesce("members", F.lit(0)) < 2)
    usable = F.when((F.col("experts") >= 2) & ~single, F.col("span"))
    out = both.groupBy(entity).agg(F.max(usable).alias("score"), F.max(single.cast("int")).alias("s"), F.max((F.col("experts") < 2).cast("int")).alias("e"))
    return out.select(entity, "score", F.when(F.col("score").isNull(), reasons(singleton_panel=F.col("s") == 1, single_expert=F.col("e") == 1)).otherwise(F.array().cast("array<string>")).alias("reasons"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def disagreement_top_k(rows: DataFrame, entity: str, by: str, threshold: float, k: int) -> DataFrame:
    """(by, entity, rank): scores above the threshold, best first; for k > 1 the last slot is kept for one unknown."""
    known = top_k(rows.where(F.col("score") >= threshold), [by], [F.desc("score"), F.col(entity)], k)
    if k == 1:
        return known.select(by, entity, "rank")
    unknown = top_k(rows.where("score is null"), [by], [F.col(entity)], 1).select(by, F.col(entity).alias("u"))
    place = known.groupBy(by).agg(F.count("*").alias("n"))
    slot = unknown.join(place, by, "left").select(by, F.col("u").alias(entity), F.least(F.coalesce("n", F.lit(0)) + 1, F.lit(k)).cast("long").alias("rank"))
    return known.select(by, entity, "rank").join(slot.select(by, "rank"), [by, "rank"], "left_anti").select(by, entity, "rank").unionByName(slot)


def rank_fusion(branches: DataFrame, entity: str, weights: dict[str, float] = BRANCH_WEIGHTS, k: int = FUSION_K) -> DataFrame:
    """Weighted reciprocal-rank fusion as a share of the greatest possible sum, at most 1; null scores add nothing."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("branch"))
    most = sum(weights.values()) / (k + 1)
    part = F.when(F.col("score").isNotNull(), weight / (k + F.col("rank")))
    return branches.groupBy(entity).agg(F.least(F.lit(1.0), F.coalesce(F.sum(part), F.lit(0.0)) / most).alias("fused"), F.count("*").alias("n_branches"))


def latest_record(rows: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """The latest row of each key, and whether its rows of the same order differ in payload (an error)."""
    place = F.struct(*order)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order, payload)).alias("r"), F.max(place).alias("o"))
    same = rows.withColumn("o", place).groupBy(key, "o").agg(F.countDistinct(payload).alias("variants"))
    return last.join(same, [key, "o"]).select(key, "r.*", (F.col("variants") > 1).alias("conflict"))


def conformal_quantile(scores: DataFrame, scope: str, score: str, alpha: float) -> DataFrame:
    """Split-conformal quantile of each scope: the order statistic ceil((n + 1)(1 - alpha)), or a reason where n is too small."""
    sizes = scores.groupBy(scope).agg(F.count(score).alias("n")).withColumn("k", F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha) - 1e-12))
    # The k-th smallest by its count of smaller or equal ones: values first, so a hot scope has partial sums.
    values = scores.groupBy(scope, score).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(scope).orderBy(score))
    hit = values.withColumn("upto", upto).join(sizes.select(scope, "k"), scope).where("upto >= k").groupBy(scope).agg(F.min(score).alias("q"))
    out = sizes.join(hit, scope, "left")
    return out.select(scope, "n", F.col("k").cast("long").alias("rank"), F.when(F.col("k") <= F.col("n"), F.col("q")).alias("quantile"), F.when(F.col("k") > F.col("n"), "calibration_set_too_small").alias("reason"))


def conformal_rank(n: int, alpha: float) -> int:
    """Rank of the finite-sample quantile; raises where the sample is too small."""
    k = math.ceil((n + 1) * (1.0 - alpha) - 1e-12)
    if not 0 < alpha < 1 or k > n:
        raise ValueError("the calibration sample is too small for alpha")
    return k


def shortlist(ranked: DataFrame, entity: str, digest: str, k: int) -> DataFrame:
    """The first k rows by tier and rank whose content is new among them."""
    first = top_k(ranked, [digest], [F.col("tier"), F.col("rank"), F.col(entity)], 1, "_d").drop("_d")
    return first.orderBy("tier", "rank", entity).limit(k)
