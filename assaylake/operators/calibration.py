"""Calibration artifacts and the requests that lie in their scope: containment of sets by their rarest member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import reasons
from assaylake.session import materialize

#: What a request and its artifact must have equal, beside the scope, and the reason where no artifact of the scope has it.
EXACT = {
    "revisions": "expert_weight_revision_mismatch",
    "method": "dft_method_mismatch",
    "reference_hash": "dft_reference_hash_mismatch",
    "proxy_name": "proxy_not_calibrated",
}
KEYS = ["scope_id", *EXACT, "unit"]


def set_containment(probes: DataFrame, sets: DataFrame, on: list[str], key: str, elements: str, owner: str, allowed: str, also: Column | None = None) -> DataFrame:
    """(key, owner): for each probe the least owner whose allowed set holds all its elements, with equal ``on`` columns.

    A probe meets only the sets that hold the one of its elements that fewest sets hold. An empty set of
    elements is in every allowed set; a null one, or one with a null member, is in none, and null ``on``
    columns match nothing. ``also`` is a further condition on the columns of both sides.
    """
    named = lambda c: F.concat(F.array(F.lit("*")), F.transform(F.array_distinct(c), lambda x: F.concat(F.lit("="), x)))
    index = sets.where(F.col(allowed).isNotNull()).withColumn("_x", F.explode(named(F.filter(allowed, lambda x: x.isNotNull()))))
    counts = index.groupBy(*on, "_x").agg(F.count("*").alias("_n"))
    known = probes.where(F.col(elements).isNotNull() & ~F.exists(elements, lambda x: x.isNull()))
    asked = known.select(key, *on, F.explode(named(F.col(elements))).alias("_x")).join(counts, [*on, "_x"], "left")
    rarest = asked.groupBy(key).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_x").alias("x"))).alias("_r")).where("_r.n > 0")
    met = known.join(rarest.select(key, F.col("_r.x").alias("_x")), key).join(index, [*on, "_x"])
    holds = F.size(F.array_except(elements, allowed)) == 0
    return met.where(holds if also is None else holds & also).groupBy(key).agg(F.min(owner).alias(owner))


def assess_proxies(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """candidate_id, proxy_name, artifact_id, lower_bound, upper_bound, coverage and reasons (none: calibrated in scope).

    requests: candidate_id, scope_id, elements, composition, revisions, method, reference_hash,
    proxy_name, unit, value. artifacts, a row per metric: artifact_id, allowed_elements,
    allowed_compositions (null or empty: any), quantile, coverage and the columns of KEYS. The interval
    is of the least artifact that matches in everything. Otherwise nothing is calibrated, and the
    reasons say what no artifact of the request's scope has; ``no_single_artifact`` if each alone is met.
    Requests that differ in value alone are matched once; repeated requests keep their rows.
    """
    what = F.struct(*KEYS, "elements", "composition")
    # Both are read many times below: written once, so that their plans aren't repeated in each join.
    artifacts = materialize(artifacts.select(*KEYS, "artifact_id", "allowed_elements", "allowed_compositions", "quantile", "coverage"), "artifacts")
    requests = requests.select("candidate_id", "value", *KEYS, "elements", "composition")
    signed = materialize(requests.withColumn("_sid", F.sha2(F.to_json(what, {"ignoreNullFields": "false"}), 256)), "requests")
    probes = signed.select("_sid", *KEYS, "elements", "composition").dropDuplicates(["_sid"])
    free = F.coalesce(F.size("allowed_compositions") <= 0, F.lit(True))
    fits = free | F.coalesce(F.array_contains("allowed_compositions", F.col("composition")), F.lit(False))
    sets = artifacts.select(*KEYS, "artifact_id", "allowed_elements", "allowed_compositions")
    hits = set_containment(probes, sets, KEYS, "_sid", "elements", "artifact_id", "allowed_elements", fits)

    def has(name: str, on: list[str], part: DataFrame) -> DataFrame:
        return part.select(*on).distinct().withColumn(name, F.lit(True))

    checks = {"scope": (["scope_id"], artifacts), **{c: (["scope_id", c], artifacts) for c in EXACT}, "proxy_unit": (["scope_id", "proxy_name", "unit"], artifacts)}
    flagged = probes
    for name, (on, part) in checks.items():
        flagged = flagged.join(has(f"_{name}", on, part), on, "left")
    flagged = materialize(flagged, "flagged")
    listed = artifacts.select("scope_id", F.explode("allowed_compositions").alias("composition"))
    flagged = flagged.join(has("_listed", ["scope_id", "composition"], listed), ["scope_id", "composition"], "left").join(has("_free", ["scope_id"], artifacts.where(free)), "scope_id", "left")
    inside = set_containment(probes, artifacts.select("scope_id", "artifact_id", "allowed_elements").distinct(), ["scope_id"], "_sid", "elements", "artifact_id", "allowed_elements")
    flagged = flagged.join(inside.select("_sid", F.lit(True).alias("_inside")), "_sid", "left").join(hits, "_sid", "left")

    lacks = lambda c: F.col(f"_{c}").isNull()
    scoped = ~lacks("scope")
    why = reasons(
        exchangeability_scope_id_mismatch=~scoped,
        chemistry_elements_out_of_scope=scoped & lacks("inside"),
        reduced_composition_out_of_scope=scoped & lacks("listed") & lacks("free"),
        proxy_unit_mismatch=~lacks("proxy_name") & lacks("proxy_unit"),
        **{reason: scoped & lacks(c) for c, reason in EXACT.items()},
    )
    why = F.when(F.col("artifact_id").isNotNull(), F.array().cast("array<string>")).when(F.size(why) > 0, why).otherwise(F.array(F.lit("no_single_artifact")))
    judged = flagged.select("_sid", "artifact_id", "proxy_name", why.alias("reasons"))
    metric = artifacts.select("artifact_id", "proxy_name", "quantile", "coverage").dropDuplicates(["artifact_id", "proxy_name"])
    found = judged.join(metric, ["artifact_id", "proxy_name"], "left").drop("proxy_name")
    out = signed.join(found, "_sid")
    return out.select("candidate_id", "proxy_name", "artifact_id", (F.col("value") - F.col("quantile")).alias("lower_bound"), (F.col("value") + F.col("quantile")).alias("upper_bound"), "coverage", "reasons")
