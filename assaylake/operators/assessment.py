"""Assessment of criteria by observations, and of evidence records by requirements, with the reason of each verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import interval_gate, is_empty, is_missing, reasons
from assaylake.functions.sizes import few

#: Reasons of a criterion's status.
CODES = {
    "available": "CONDITION_COMPLETE_NAMED_VALIDATOR",
    "conflicting": "CONFLICTING_NAMED_VALIDATORS",
    "incomparable": "UNIT_VALIDATOR_OR_CONDITION_MISMATCH",
    "unknown": "NO_SUCCESSFUL_NAMED_VALIDATOR",
}
KEY = ["candidate_id", "role_id", "criterion_id"]


def assess_criteria(candidates: DataFrame, criteria: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assessment of each candidate by each criterion of its role, and the verdict on each observation.

    candidates: candidate_id, role_id (a row each). criteria (a row each): criterion_id, role_id,
    property_name, unit, validator_ids, required_context, target (map, may be null), minimum, maximum.
    observations: observation_id, candidate_id, role_id, property_name, validator_id, unit, conditions
    (map), status, value, lower_bound, upper_bound.

    An observation counts if its validator is listed, its unit is the criterion's and all required
    conditions are filled and equal to the target where that has them. Successful ones under one set of
    conditions and with one (value, bounds) make the criterion available; several values conflict, and
    nothing is averaged. Several sets of conditions, or rows that don't count, make it incomparable;
    with nothing else it is unknown. The first table has status, value, lower_bound, upper_bound,
    conditions, n_accepted, n_rejected, hard_gate and reason_code; the second the keys, observation_id
    and whether it was accepted. Observations of no candidate or criterion are left out, repeated ones
    stay. A null validator, unit or status counts for nothing.
    """
    given, criteria = criteria, few(criteria)  # a join by a few roles is a few tasks
    asked = candidates.select("candidate_id", "role_id").join(criteria, "role_id")
    wanted = F.col("required_context")
    complete = F.forall(wanted, lambda k: ~is_missing(F.col("conditions")[k]))
    fits = F.forall(wanted, lambda k: is_missing(F.col("target")[k]) | F.coalesce(F.col("conditions")[k] == F.col("target")[k], F.lit(False)))
    counts = F.array_contains("validator_ids", F.col("validator_id")) & (F.col("unit") == F.col("_unit")) & F.coalesce(complete, F.lit(False)) & (F.col("target").isNull() | fits)
    counts = F.coalesce(counts, F.lit(False))
    success = F.coalesce(F.col("status") == "success", F.lit(False))
    verdict = F.when(~counts, "incomparable").when(success, "accepted").when(F.col("status") == "incomparable", "incomparable").otherwise("rejected")
    scoped = F.to_json(F.map_from_entries(F.transform(F.array_sort(wanted), lambda k: F.struct(k.alias("k"), F.col("conditions")[k].alias("v")))))
    of = criteria.select("role_id", "criterion_id", "property_name", F.col("unit").alias("_unit"), "validator_ids", F.coalesce("required_context", F.array().cast("array<string>")).alias("required_context"), "target")
    seen = observations.select("observation_id", "candidate_id", "role_id", "property_name", "validator_id", "unit", "conditions", "status", "value", "lower_bound", "upper_bound")
    judged = seen.join(F.broadcast(of) if criteria is not given else of, ["role_id", "property_name"]).withColumn("_verdict", verdict).withColumn("_scope", F.when(F.col("_verdict") == "accepted", scoped))
    ok = F.col("_verdict") == "accepted"
    triple = F.when(ok, F.struct("value", "lower_bound", "upper_bound"))
    grouped = judged.groupBy(*KEY).agg(
        F.count_if(ok).alias("_ok"), F.count("*").alias("_n"), F.count_if(F.col("_verdict") == "incomparable").alias("_off"),
        F.min("_scope").alias("_s1"), F.max("_scope").alias("_s2"), F.min(triple).alias("_t1"), F.max(triple).alias("_t2"),
    ).withColumn("_several", F.coalesce(F.col("_s1") != F.col("_s2"), F.lit(False)))
    base = asked.select(*KEY, "minimum", "maximum").join(grouped, KEY, "left").na.fill(0, ["_ok", "_n", "_off"]).na.fill(False, ["_several"])
    status = F.when((F.col("_ok") > 0) & ~F.col("_several"), F.when(F.col("_t1") != F.col("_t2"), "conflicting").otherwise("available")).when(F.col("_several") | (F.col("_off") > 0), "incomparable").otherwise("unknown")
    out = base.withColumn("status", status)
    available = F.col("status") == "available"
    one = lambda c: F.when(available, F.col(f"_t1.{c}")).alias(c)
    gated = F.col("minimum").isNotNull() | F.col("maximum").isNotNull()
    gate = F.when(available, interval_gate(F.col("_t1.lower_bound"), F.col("_t1.upper_bound"), F.col("minimum"), F.col("maximum"))).when(gated | (F.col("status") == "conflicting"), "unknown").otherwise("not_configured")
    accepted = F.when(F.col("_several"), F.lit(0)).otherwise(F.col("_ok")).cast("long")
    code = F.element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), F.col("status"))
    assessed = out.select(*KEY, "status", one("value"), one("lower_bound"), one("upper_bound"), F.when(available, F.col("_s1")).alias("conditions"), accepted.alias("n_accepted"), (F.col("_n") - accepted).alias("n_rejected"), gate.alias("hard_gate"), code.alias("reason_code"))
    known = asked.select(*KEY)
    split = grouped.where("_several").select(*KEY, F.lit(True).alias("_split"))
    verdicts = judged.join(known, KEY, "left_semi").join(split, KEY, "left").select(*KEY, "observation_id", (ok & F.col("_split").isNull()).alias("accepted"))
    return assessed, verdicts


#: Flags that rule a record or a result out.
DISQUALIFYING = ["failed_convergence", "out_of_domain", "invalid_output", "unresolved_conflict"]
#: Ranks of fidelities; evidence needs at least the requirement's.
FIDELITY = {"low": 1, "medium": 2, "high": 3, "experimental": 4}


def compatible_evidence(records: DataFrame, requirements: DataFrame) -> DataFrame:
    """records joined with the requirements of their gate: record_id, requirement_id, reasons (none: compatible).

    records: record_id, gate_id, candidate_id, evidence_kind, verified, status, tool_name, operation,
    method_class, fidelity, parameters_hash, convergence (map of booleans), code_revision, model (struct
    of name, version, dataset_versions, in_domain, calibration), quality_flags and properties (array of
    structs of name, in_domain, quality_flags, numeric, uncertainty, low, high, calibration).
    requirements: requirement_id, gate_id, evidence_kind, statuses, tools, operations, method_classes
    (empty or null: any), property_names, minimum_fidelity. Nulls fail closed.
    """
    listed = lambda names, value: is_empty(F.col(names)) | F.coalesce(F.array_contains(names, F.col(value)), F.lit(False))
    true = lambda c: F.coalesce(c, F.lit(False))
    flagged = lambda flags: true(F.exists(flags, lambda f: F.lower(f).isin(*DISQUALIFYING)))
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in FIDELITY.items() for x in p]), c)
    wanted = requirements.select("requirement_id", "gate_id", F.col("evidence_kind").alias("_kind"), "statuses", "tools", "operations", "method_classes", "property_names", "minimum_fidelity")
    both = records.join(few(wanted), "gate_id")
    lab = F.col("_kind") == "experimental"
    careful = ~lab & F.col("fidelity").isin("medium", "high")
    learned = ~lab & true(F.col("method_class") == "machine_learning")
    model = lambda field: F.col(f"model.{field}")
    whole_model = ~is_missing(model("name")) & ~is_missing(model("version")) & ~is_empty(model("dataset_versions")) & true(model("in_domain")) & ~is_missing(model("calibration"))
    names = F.transform("property_names", F.lower)
    relevant = F.when(lab, F.array().cast(records.schema["properties"].dataType)).otherwise(F.filter("properties", lambda p: is_empty(F.col("property_names")) | true(F.array_contains(names, F.lower(p["name"])))))
    some = lambda rule: true(F.exists(relevant, rule))
    unsure = lambda p: true(p["numeric"]) & p["uncertainty"].isNull() & (p["low"].isNull() | p["high"].isNull())
    converged = ~is_empty(F.col("convergence")) & true(F.forall(F.map_values("convergence"), lambda v: v))
    rules = {
        "candidate_missing": F.col("candidate_id").isNull(),
        "kind_mismatch": ~true(F.col("evidence_kind") == F.col("_kind")),
        "experiment_not_verified": lab & ~true(F.col("verified")),
        "status_not_accepted": ~true(F.array_contains("statuses", F.col("status"))),
        "tool_not_allowed": ~listed("tools", "tool_name"),
        "operation_not_allowed": ~listed("operations", "operation"),
        "method_class_not_allowed": ~listed("method_classes", "method_class"),
        "experimental_fidelity_missing": lab & ~true(F.col("fidelity") == "experimental"),
        "parameters_hash_missing": careful & is_missing(F.col("parameters_hash")),
        "not_converged": careful & ~converged,
        "revision_missing": careful & is_missing(F.col("code_revision")),
        "model_metadata_missing": learned & ~whole_model,
        "disqualifying_flag": ~lab & flagged(F.col("quality_flags")),
        "property_out_of_domain": some(lambda p: ~F.coalesce(p["in_domain"], F.lit(True))),
        "property_flag": some(lambda p: flagged(p["quality_flags"])),
        "property_without_uncertainty": careful & some(unsure),
        "property_not_calibrated": learned & some(lambda p: ~true(p["in_domain"]) | is_missing(p["calibration"])),
        "fidelity_too_low": ~lab & ~true(rank(F.col("fidelity")) >= rank(F.col("minimum_fidelity"))),
    }
    return both.select("record_id", "requirement_id", reasons(**{n: true(c) for n, c in rules.items()}).alias("reasons"))


def explain(candidates: DataFrame, assessed: DataFrame) -> DataFrame:
    """candidate_id, role_id, completeness (percent), uncertainty and the sorted codes why, why_not, tradeoffs, doubts and next_steps.

    candidates (a row a candidate and role): candidate_id, role_id, origin, front, score, hard_gate,
    model_disagreement, identity_status. assessed: the first table of assess_criteria. Uncertainty is
    conflicting, unknown, bounded or point_only, in that order of precedence; a candidate without
    criteria is point_only and 0 percent complete. Trade-offs and steps name the criterion before a colon.
    """
    has = lambda s: F.count_if(F.col("status") == s)
    open_ = F.col("status") != "available"
    named = lambda when, text: F.array_sort(F.collect_set(F.when(when, F.concat(F.col("criterion_id"), F.lit(":"), text))))
    facts = assessed.groupBy("candidate_id", "role_id").agg(
        F.count("*").alias("n"), *[has(s).alias(f"n_{s}") for s in CODES], F.count_if(~open_ & F.col("lower_bound").isNull()).alias("n_points"),
        named(open_, F.col("status")).alias("tradeoffs"), named(open_, F.lit("run_named_validator")).alias("steps"),  # a role's few criteria
    )
    none = F.array().cast("array<string>")
    rows = candidates.join(facts, ["candidate_id", "role_id"], "left").na.fill(0, ["n", "n_points", *[f"n_{s}" for s in CODES]])
    some = lambda s: F.col(f"n_{s}") > 0
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    open_n = F.col("n") - F.col("n_available")
    uncertainty = F.when(some("conflicting"), "conflicting").when(open_n > 0, "unknown").when((F.col("n") > 0) & (F.col("n_points") == 0), "bounded").otherwise("point_only")
    why = reasons(
        SOURCE_BACKED_RETRIEVAL_SEED=is_("origin", "retrieval_seed"),
        ROBUST_NON_DOMINATED_WITHIN_ROLE_AND_CONDITION=is_("front", 1),
        OPERATOR_WEIGHTED_POOL_RELATIVE_SCORE_AVAILABLE=F.col("score").isNotNull(),
        ALL_CONFIGURED_HARD_GATES_PASS=is_("hard_gate", "pass"),
        NAMED_VALIDATOR_EVIDENCE_AVAILABLE=some("available"),
        EXTERNAL_DATABASE_SCOPED_NO_MATCH_RETAINED_AS_CONTEXT_ONLY=is_("identity_status", "database_scoped_no_match"),
    )
    front = F.when(F.col("front") > 1, F.array(F.concat(F.lit("PARETO_FRONT_"), F.col("front").cast("string")))).otherwise(none)
    why = F.array_sort(F.concat(why, front))
    why_not = reasons(
        DOMINATED_WITHIN_MATCHED_ROLE_AND_CONDITION=F.coalesce(F.col("front") > 1, F.lit(False)),
        AT_LEAST_ONE_CONFIGURED_HARD_GATE_FAILS=is_("hard_gate", "fail"),
        HARD_GATE_UNCERTAINTY_OR_MISSING_EVIDENCE=is_("hard_gate", "unknown"),
        NO_CONDITION_COMPLETE_PERFORMANCE_EVIDENCE=~some("available"),
        HIGH_MODEL_DISAGREEMENT=is_("model_disagreement", "high"),
    )
    doubts = reasons(
        criterion_without_named_validator=some("unknown"), evidence_incomparable=some("incomparable"), validators_disagree=some("conflicting"), no_quantified_uncertainty=F.col("n_points") > 0,
        models_disagree=is_("model_disagreement", "high"), identity_unresolved=is_("identity_status", "unknown"), no_match_is_no_proof=is_("identity_status", "database_scoped_no_match"),
    )
    steps = F.concat(F.coalesce("steps", none), reasons(resolve_model_disagreement=is_("model_disagreement", "high"), close_retrieval_seed=is_("origin", "retrieval_seed")))
    return rows.select(
        "candidate_id", "role_id", F.when(F.col("n") > 0, 100.0 * F.col("n_available") / F.col("n")).otherwise(0.0).alias("completeness"), uncertainty.alias("uncertainty"),
        F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("UNSCORED_CANDIDATE_RETAINED"))).alias("why"), why_not.alias("why_not"), F.coalesce("tradeoffs", none).alias("tradeoffs"), doubts.alias("doubts"), F.array_sort(steps).alias("next_steps"),
    )


def relaxation_failures(converged: Column, force: Column, distance: Column, volume_change: Column, stress: Column, same_atoms: Column, valid: Column, limits: dict[str, float]) -> Column:
    """Sorted codes of what a relaxation broke (none: passed); limits: force, distance, volume_change, stress. Missing values fail."""
    fails = lambda c: F.coalesce(c, F.lit(True))
    return reasons(
        optimizer_not_converged=fails(~converged),
        final_force_above_target=fails(force > limits["force"]),
        minimum_distance_below_safety_threshold=fails(distance < limits["distance"]),
        volume_change_above_allowed_limit=fails(F.abs(volume_change) > limits["volume_change"]),
        final_stress_unavailable=stress.isNull(),
        final_stress_above_allowed_limit=F.coalesce(stress > limits["stress"], F.lit(False)),
        relaxed_atom_count_changed=fails(~same_atoms),
        invalid_relaxed_geometry=fails(~valid),
    )
