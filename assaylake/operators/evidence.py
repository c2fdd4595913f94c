"""Aggregates over expert evidence: fail-closed means, disagreement, normalisation, goal scores, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import constraint_met, reasons
from assaylake.functions.sizes import dictionary


def unambiguous(rows: DataFrame, keys: list[str], value: str = "value", unit: str = "unit") -> DataFrame:
    """Rows of the keys that hold a single (value, unit); conflicting keys are dropped whole."""
    pair = F.struct(F.coalesce(F.col(unit), F.lit("\0")).alias("u"), F.col(value).alias("v"))
    one = rows.groupBy(*keys).agg(F.min(pair).alias("low"), F.max(pair).alias("high"), F.first(value).alias(value), F.first(unit).alias(unit))
    return one.where("low = high").drop("low", "high")


def property_aggregate(rows: DataFrame, keys: list[str], value: str, unit: str, source: str, uncertainty: str | None = None, out_of_domain: str | None = None) -> DataFrame:
    """Mean, count, sorted sources, largest uncertainty and whether any row is out of domain, per key; mixed units (a
    missing one is a unit) give no mean and no uncertainty but a warning."""
    tag = F.coalesce(F.col(unit), F.lit("\0"))
    more = [F.max(uncertainty).alias("max_uncertainty")] if uncertainty else []
    more += [(F.max(F.coalesce(F.col(out_of_domain), F.lit(False)).cast("int")) == 1).alias("any_out_of_domain")] if out_of_domain else []
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_values"), F.min(tag).alias("_low"), F.max(tag).alias("_high"), F.first(unit).alias("unit"), F.array_sort(F.collect_set(source)).alias("sources"), *more)
    mixed = F.col("_low") != F.col("_high")
    only = lambda c: F.when(~mixed, F.col(c)).alias(c)
    return out.select(*keys, only("mean_value"), "n_values", only("unit"), "sources", F.when(mixed, "mixed_units").alias("warning"), *[only("max_uncertainty")] * bool(uncertainty), *["any_out_of_domain"] * bool(out_of_domain))


def expert_disagreement(rows: DataFrame, entity: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Per entity the largest span over properties, relative to the larger magnitude, at most 1.

    Properties with fewer than two experts or with mixed units don't count; without any the result is null.
    """
    panel = rows.where(~F.col("property_name").isin(*exclude)) if exclude else rows
    spans = panel.groupBy(entity, "property_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("expert_id").alias("experts"), F.min("unit").alias("u1"), F.max("unit").alias("u2"))
    span = F.least(F.lit(1.0), (F.col("hi") - F.col("lo")) / F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1e-12)))
    usable = F.when((F.col("experts") >= 2) & F.col("u1").eqNullSafe(F.col("u2")), span)
    return spans.groupBy(entity).agg(F.max(usable).alias("disagreement"), F.count(usable).cast("long").alias("n_compared"))


def min_max(rows: DataFrame, value: str, by: list[str], name: str = "normalized", constant: float = 1.0) -> DataFrame:
    """Min-max normalisation inside groups; a constant group gets ``constant``. The ends are aggregates with partial sums, joined back."""
    key = F.struct(*[F.col(c) for c in by])
    ends = rows.groupBy(key.alias("_key")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high > low, (F.col(value) - low) / (high - low)).when(F.col(value).isNotNull(), F.lit(constant))
    return rows.join(ends, key.eqNullSafe(F.col("_key"))).withColumn(name, scaled).drop("_key", "_low", "_high")


def goal_score(rows: DataFrame, weights: DataFrame, entity: str) -> DataFrame:
    """Weighted mean over properties (weights above 0) of the least normalised utility among experts.

    A weighted property that an entity lacks makes its score null.
    """
    used = weights.where("weight > 0")
    wanted = used.count()
    worst = rows.groupBy(entity, "property_name").agg(F.min("normalized").alias("worst"))
    joined = worst.join(dictionary(used), "property_name")
    out = joined.groupBy(entity).agg((F.sum(F.col("weight") * F.col("worst")) / F.sum("weight")).alias("s"), F.count("worst").alias("n"))
    return out.select(entity, F.when(F.col("n") == wanted, F.col("s")).alias("goal_score"))


def hard_constraints(rows: DataFrame, constraints: DataFrame, entity: str, entities: DataFrame) -> DataFrame:
    """Per entity the sorted reasons why it breaks constraints: a failing expert, mixed units or a missing property."""
    each = rows.join(dictionary(constraints), "property_name")
    met = constraint_met(F.col("value"), F.col("operator"), F.col("first"), F.col("second"))
    seen = each.groupBy(entity, "constraint_id").agg(F.min(met.cast("int")).alias("ok"), F.min("unit").alias("u1"), F.max("unit").alias("u2"))
    why = F.when(F.col("u1") != F.col("u2"), F.concat(F.lit("mixed_units:"), "constraint_id")).when(F.coalesce(F.col("ok"), F.lit(0)) == 0, F.concat(F.lit("violated:"), "constraint_id"))
    found = seen.groupBy(entity).agg(F.collect_set(why).alias("w"), F.collect_set("constraint_id").alias("have"))
    ids = F.lit([r.constraint_id for r in constraints.select("constraint_id").distinct().orderBy("constraint_id").collect()])
    missing = F.transform(F.array_except(ids, F.coalesce("have", F.array().cast("array<string>"))), lambda c: F.concat(F.lit("missing:"), c))
    out = entities.join(found, entity, "left")
    return out.select(entity, F.array_sort(F.concat(F.coalesce("w", F.array().cast("array<string>")), missing)).alias("reasons"))


def mean_vector(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Element-wise mean of equally long vectors as (group, position, mean); other lengths void the group."""
    sizes = rows.groupBy(group).agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"))
    parts = rows.select(group, F.posexplode(vector).alias("position", "x"))
    means = parts.groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    return means.join(sizes.where("a = b").select(group), group)


def eligibility(rows: DataFrame, entity: str, **rules: Column) -> DataFrame:
    """rows with the sorted reasons array and eligible (no reason)."""
    return rows.withColumn("reasons", reasons(**rules)).withColumn("eligible", F.size("reasons") == 0)


def control_vector(requests: DataFrame, features: DataFrame, utility: str, disagreement: DataFrame) -> DataFrame:
    """The eight control values of each request, and why one has none.

    requests (a row a candidate): candidate_id, cycle, expected and failed (arrays of expert ids),
    previous_improvement, collapse_rate, alpha. features: candidate_id, expert_id, status (success,
    partial or else) and the utility of each primary value (null where it serves no objective).
    disagreement: candidate_id, disagreement, of successful values.

    An expert is successful if one of its features is; failed, missing (expected without a feature) and
    partial-only experts are counted as not successful, each once. Without a utility or disagreement the
    neutral 0 stands; a candidate without any feature has null values and a reason.
    """
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    seen = features.groupBy("candidate_id", "expert_id").agg(F.max(ok.cast("int")).alias("ok"), F.max(F.coalesce(F.col("status") == "partial", F.lit(False)).cast("int")).alias("counted"))
    asked = requests.select("candidate_id", F.explode(F.array_union(F.coalesce("expected", F.array().cast("array<string>")), F.coalesce("failed", F.array().cast("array<string>")))).alias("expert_id"), "failed")
    asked = asked.select("candidate_id", "expert_id", F.coalesce(F.array_contains("failed", F.col("expert_id")), F.lit(False)).cast("int").alias("failed"))
    both = seen.join(asked, ["candidate_id", "expert_id"], "full")
    missing = F.col("ok").isNull()
    off = (missing | (F.col("counted") == 1) | (F.col("failed") == 1)) & ~F.coalesce(F.col("ok") == 1, F.lit(False))
    experts = both.groupBy("candidate_id").agg(F.count_if(F.col("ok") == 1).alias("n_successful"), F.count_if(off).alias("n_unsuccessful"), F.count("ok").alias("_seen"))
    worst = features.where(ok).groupBy("candidate_id").agg(F.min(utility).alias("worst_utility"))
    out = requests.join(experts, "candidate_id", "left").join(worst, "candidate_id", "left").join(disagreement.select("candidate_id", "disagreement"), "candidate_id", "left")
    known = F.coalesce(F.col("_seen") > 0, F.lit(False))
    values = {
        "cycle": F.col("cycle").cast("double"), "n_successful": F.col("n_successful").cast("double"), "n_unsuccessful": F.col("n_unsuccessful").cast("double"), "worst_utility": F.coalesce("worst_utility", F.lit(0.0)),
        "disagreement": F.coalesce("disagreement", F.lit(0.0)), "improved": F.coalesce((F.col("previous_improvement") > 0).cast("double"), F.lit(0.0)), "collapse_rate": F.col("collapse_rate"), "alpha": F.col("alpha"),
    }
    return out.select("candidate_id", *[F.when(known, v).alias(n) for n, v in values.items()], F.when(~known, "no_primary_feature").alias("reason"))
