"""Explanation codes and the relaxation gate on odd rows."""

from pyspark.sql import functions as F

from assaylake.operators import assessment

CANDIDATES = "candidate_id string, role_id string, origin string, front int, score double, hard_gate string, model_disagreement string, identity_status string"
ASSESSED = "candidate_id string, role_id string, criterion_id string, status string, lower_bound double"
LIMITS = {"force": 1.0, "distance": 0.5, "volume_change": 0.2, "stress": 2.0}


def test_codes(spark):
    candidates = spark.createDataFrame([("a", "r", None, 1, 2.0, "pass", None, None), ("b", "r", "retrieval_seed", 3, None, "unknown", "high", "unknown"), ("c", "r", None, None, None, None, None, None)], CANDIDATES)
    assessed = spark.createDataFrame([("a", "r", "k1", "available", 1.0), ("a", "r", "k2", "available", None), ("b", "r", "k1", "conflicting", None), ("b", "r", "k2", "unknown", None), ("z", "r", "k1", "available", 1.0)], ASSESSED)
    got = {r.candidate_id: r for r in assessment.explain(candidates, assessed).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].completeness, got["a"].uncertainty, got["a"].why_not, got["a"].tradeoffs, got["a"].doubts) == (100.0, "point_only", [], [], ["no_quantified_uncertainty"])
    assert got["a"].why == ["ALL_CONFIGURED_HARD_GATES_PASS", "NAMED_VALIDATOR_EVIDENCE_AVAILABLE", "OPERATOR_WEIGHTED_POOL_RELATIVE_SCORE_AVAILABLE", "ROBUST_NON_DOMINATED_WITHIN_ROLE_AND_CONDITION"]
    b = got["b"]
    assert (b.completeness, b.uncertainty, b.why, b.tradeoffs) == (0.0, "conflicting", ["PARETO_FRONT_3", "SOURCE_BACKED_RETRIEVAL_SEED"], ["k1:conflicting", "k2:unknown"])
    assert b.why_not == ["DOMINATED_WITHIN_MATCHED_ROLE_AND_CONDITION", "HARD_GATE_UNCERTAINTY_OR_MISSING_EVIDENCE", "HIGH_MODEL_DISAGREEMENT", "NO_CONDITION_COMPLETE_PERFORMANCE_EVIDENCE"]
    assert b.next_steps == ["close_retrieval_seed", "k1:run_named_validator", "k2:run_named_validator", "resolve_model_disagreement"]
    assert (got["c"].completeness, got["c"].uncertainty, got["c"].why, got["c"].tradeoffs) == (0.0, "point_only", ["UNSCORED_CANDIDATE_RETAINED"], [])
    assert assessment.explain(candidates.limit(0), assessed).collect() == []


def test_relaxation(spark):
    rows = spark.createDataFrame([(1, True, 0.5, 0.6, -0.1, 1.0, True, True), (2, False, 1.5, 0.4, -0.3, 3.0, False, False), (3, None, None, None, None, None, None, None)], "id long, converged boolean, force double, distance double, change double, stress double, same boolean, valid boolean")
    why = assessment.relaxation_failures(*map(F.col, ("converged", "force", "distance", "change", "stress", "same", "valid")), LIMITS)
    got = {r.id: r.why for r in rows.select("id", why.alias("why")).collect()}
    rest = ["final_force_above_target", "invalid_relaxed_geometry", "minimum_distance_below_safety_threshold", "optimizer_not_converged", "relaxed_atom_count_changed", "volume_change_above_allowed_limit"]
    assert got == {1: [], 2: sorted([*rest, "final_stress_above_allowed_limit"]), 3: sorted([*rest, "final_stress_unavailable"])}
