"""Criterion assessment and evidence compatibility against plain loops over odd rows."""

import json
import random
from collections import defaultdict

import pytest

from assaylake.operators import assessment

CANDIDATES = "candidate_id string, role_id string"
CRITERIA = "criterion_id string, role_id string, property_name string, unit string, validator_ids array<string>, required_context array<string>, target map<string,string>, minimum double, maximum double"
OBSERVATIONS = "observation_id long, candidate_id string, role_id string, property_name string, validator_id string, unit string, conditions map<string,string>, status string, value double, lower_bound double, upper_bound double, target string"
names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def plain(criterion, observations):
    missing = lambda v: v is None or not v.strip()
    accepted, rejected, off = [], [], False
    for o in observations:
        conditions, target = o["conditions"] or {}, criterion["target"] or {}
        needed = criterion["required_context"] or []
        fits = o["validator_id"] in criterion["validator_ids"] and o["unit"] == criterion["unit"] and not any(missing(conditions.get(k)) for k in needed)
        fits = fits and all(missing(target.get(k)) or conditions.get(k) == target[k] for k in needed)
        if fits and o["status"] == "success":
            accepted.append(o)
        else:
            rejected.append(o)
            off |= not fits or o["status"] == "incomparable"
    scopes = {json.dumps([o["conditions"].get(k) if o["conditions"] else None for k in sorted(criterion["required_context"] or [])]) for o in accepted}
    if len(scopes) > 1:
        accepted, rejected, off = [], observations, True
    values = {(o["value"], o["lower_bound"], o["upper_bound"]) for o in accepted}
    status = "conflicting" if len(values) > 1 else "available" if values else "incomparable" if off else "unknown"
    low, high = criterion["minimum"], criterion["maximum"]
    if status == "available":
        v, lo, hi = values.pop()
        gate = "not_configured" if low is None and high is None else "unknown" if lo is None or hi is None else "fail" if (low is not None and hi < low) or (high is not None and lo > high) else "unknown" if (low is not None and lo < low) or (high is not None and hi > high) else "pass"
    else:
        v, gate = None, "unknown" if low is not None or high is not None or status == "conflicting" else "not_configured"
    return (status, v, len(accepted), len(rejected), gate), sorted((o["observation_id"], o in accepted) for o in observations)


@pytest.mark.parametrize("seed", range(3))
def test_criteria(spark, seed):
    rng = random.Random(seed)
    some = lambda *xs: rng.choice(xs)
    candidates = [(f"c{i}", r) for i in range(12) for r in ("r1", "r2") if rng.random() < 0.8]
    criteria = [
        ("k1", "r1", "p", "eV", ["v1", "v2"], ["T", "x"], {"T": "300", "x": " "}, 1.0, None), ("k2", "r1", "q", "m", ["v1"], [], None, None, None),
        ("k3", "r2", "p", "eV", ["v1", "v3"], ["T"], None, 0.0, 2.0), ("k4", "r2", "p", "K", ["v2"], None, {"T": "1"}, None, 2.0), ("k5", "r3", "p", "eV", ["v1"], [], None, None, None),
    ]
    observations = []
    for i in range(260):
        low = some(None, 0.5, 1.5)
        observations.append((i, f"c{rng.randrange(14)}", some("r1", "r2"), some("p", "p", "q", "z"), some("v1", "v1", "v2", None), some("eV", "eV", "m", "K", None), some({"T": "300", "x": "1"}, {"T": "300", "x": "1"}, {"T": "400", "x": "1"}, {"T": " "}, None), some("success", "success", "success", "failed", "incomparable", None), some(1.0, 1.0, 2.0), low, None if low is None else low + some(0.5, 1.0), "clash"))
    observations += observations[:20]
    candidates += [("cc", "r2"), ("nobody's", "r1")]
    observations += [(900 + i, "cc", "r2", "p", v, "eV", {"T": "1"}, "success", x, x, x, None) for i, (v, x) in enumerate([("v1", 1.0), ("v3", 1.5)])]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((candidates, CANDIDATES), (criteria, CRITERIA), (observations, OBSERVATIONS))]
    found, verdicts = assessment.assess_criteria(*tables)
    by_key, ids = defaultdict(list), defaultdict(list)
    for o in observations:
        by_key[o[1], o[2], o[3]].append(dict(zip(names(OBSERVATIONS), o, strict=True)))
    for r in verdicts.collect():
        ids[r.candidate_id, r.role_id, r.criterion_id].append((r.observation_id, r.accepted))
    rows = {(r.candidate_id, r.role_id, r.criterion_id): r for r in found.collect()}
    asked = [(c, r, dict(zip(names(CRITERIA), k, strict=True))) for c, r in candidates for k in criteria if k[1] == r]
    assert len(rows) == len(asked)
    seen = set()
    for c, r, k in asked:
        want, marks = plain(k, by_key[c, r, k["property_name"]])
        got = rows[c, r, k["criterion_id"]]
        assert (got.status, got.value, got.n_accepted, got.n_rejected, got.hard_gate) == want, (c, k)
        assert sorted(ids.pop((c, r, k["criterion_id"]), [])) == marks
        seen.add(want[0])
    assert not ids and seen == set(assessment.CODES)


def test_empty_criteria(spark):
    one, criteria, none = spark.createDataFrame([("c", "r")], CANDIDATES), spark.createDataFrame([("k", "r", "p", "u", ["v"], None, None, None, 1.0)], CRITERIA), spark.createDataFrame([], OBSERVATIONS)
    assert [(r.status, r.hard_gate, r.n_rejected) for r in assessment.assess_criteria(one, criteria, none)[0].collect()] == [("unknown", "unknown", 0)]
    assert assessment.assess_criteria(one.limit(0), criteria, none)[0].collect() == []


RECORD = "record_id long, gate_id string, candidate_id string, evidence_kind string, verified boolean, status string, tool_name string, operation string, method_class string, fidelity string, parameters_hash string, convergence map<string,boolean>, code_revision string, model struct<name:string,version:string,dataset_versions:array<string>,in_domain:boolean,calibration:string>, quality_flags array<string>, properties array<struct<name:string,in_domain:boolean,quality_flags:array<string>,numeric:boolean,uncertainty:double,low:double,high:double,calibration:string>>"
REQUIREMENT = "requirement_id string, gate_id string, evidence_kind string, statuses array<string>, tools array<string>, operations array<string>, method_classes array<string>, property_names array<string>, minimum_fidelity string"


def test_evidence(spark):
    """A good record, and each rule broken alone; nulls fail closed."""
    model = ("net", "1", ["d"], True, "c")
    prop = ("Gap", True, ["ok"], True, 0.1, None, None, "c")
    good = {"record_id": 0, "gate_id": "g", "candidate_id": "c", "evidence_kind": "computational", "verified": None, "status": "success", "tool_name": "t", "operation": "o", "method_class": "machine_learning", "fidelity": "high", "parameters_hash": "h", "convergence": {"a": True}, "code_revision": "r", "model": model, "quality_flags": None, "properties": [prop, ("other", False, ["out_of_domain"], True, None, None, None, None)]}
    changed = [
        ({}, []), ({"candidate_id": None}, ["candidate_missing"]), ({"status": None}, ["status_not_accepted"]), ({"tool_name": "x"}, ["tool_not_allowed"]), ({"operation": None}, []),
        ({"parameters_hash": " "}, ["parameters_hash_missing"]), ({"convergence": {}}, ["not_converged"]), ({"convergence": {"a": True, "b": None}}, ["not_converged"]), ({"code_revision": None}, ["revision_missing"]),
        ({"model": None}, ["model_metadata_missing"]), ({"model": ("net", "1", [], True, "c")}, ["model_metadata_missing"]), ({"quality_flags": ["Invalid_Output"]}, ["disqualifying_flag"]),
        ({"properties": [("GAP", False, [], False, None, None, None, "c")]}, ["property_not_calibrated", "property_out_of_domain"]), ({"properties": [("gap", True, ["failed_convergence"], True, 0.1, None, None, "c")]}, ["property_flag"]),
        ({"properties": [("gap", True, None, True, None, 1.0, None, "c")]}, ["property_without_uncertainty"]), ({"properties": [("gap", True, None, True, None, 1.0, 2.0, "c")]}, []), ({"properties": []}, []), ({"properties": None}, []),
        ({"fidelity": "low", "convergence": None, "parameters_hash": None, "code_revision": None}, ["fidelity_too_low"]), ({"fidelity": None}, ["fidelity_too_low"]), ({"method_class": "simulation", "model": None}, []),
        ({"evidence_kind": "experimental"}, ["kind_mismatch"]), ({"gate_id": None}, None), ({"gate_id": "other"}, None),
    ]
    rows = [tuple({**good, **change, "record_id": i}.values()) for i, (change, _) in enumerate(changed)]
    wanted = spark.createDataFrame([("r", "g", "computational", ["success"], ["t"], None, [], ["gap"], "medium")], REQUIREMENT)
    got = {r.record_id: r.reasons for r in assessment.compatible_evidence(spark.createDataFrame(rows, RECORD), wanted).collect()}
    assert got == {i: why for i, (_, why) in enumerate(changed) if why is not None}
    lab = spark.createDataFrame([("r", "g", "experimental", ["success"], None, None, None, None, "experimental")], REQUIREMENT)
    rows = [tuple({**good, "evidence_kind": "experimental", "verified": v, "fidelity": f, "convergence": None, "model": None, "record_id": i}.values()) for i, (v, f) in enumerate([(True, "experimental"), (None, "experimental"), (True, "high")])]
    got = {r.record_id: r.reasons for r in assessment.compatible_evidence(spark.createDataFrame(rows, RECORD), lab).collect()}
    assert got == {0: [], 1: ["experiment_not_verified"], 2: ["experimental_fidelity_missing"]}
