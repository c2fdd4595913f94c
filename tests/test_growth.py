"""Steps whose cost must grow no faster than their input."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.functions.sizes import few
from assaylake.operators import chemistry, claims, control, fronts, routing
from assaylake.plans import novelty


def test_allocation_of_many_rounds_is_one_pass():
    """A frame grouped by round took about 0.3 ms a round (30 s here)."""
    n, rng = 100_000, random.Random(2)
    part = pd.DataFrame({"round_index": range(n), "objective_improvement": [rng.uniform(-1, 1) for _ in range(n)], "structural_collapse_rate": [0.0] * n, "failed": [False] * n})
    began = time.process_time()
    rows = control.allocate(part, control.Arms([0.9, 0.8], [0, 0]), "round_index", None)
    assert len(rows) == n and time.process_time() - began < 8


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_routes_are_distinct_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Repeated candidates and routes, an empty type list, nulls, and blocks of two members."""
    monkeypatch.setattr(routing, "CLASS_BLOCK", 2)
    rng = random.Random(5)
    kinds = lambda: rng.choice([None, [], ["a"], ["b", "a"], ["a", "a", None], ["c"]])
    shown = [(rng.randrange(25), rng.choice(["x", "y", None]), kinds()) for _ in range(40)]
    asked = [(rng.randrange(8), rng.choice(["m", "n"]), rng.choice(["s", None]), rng.choice([None, [], ["x"], ["x", "y"]]), kinds()) for _ in range(40)]
    want = {(c, e, m, f) for c, t, ks in shown for e, m, f, ts, ls in asked if ts is not None and (not ts or t in ts and t is not None) and {k for k in ks or [] if k} & {k for k in ls or [] if k}}
    candidates = spark.createDataFrame(shown, "candidate_id long, candidate_type string, kinds array<string>")
    routes = spark.createDataFrame(asked, "expert_id long, modality string, feature_space string, types array<string>, kinds array<string>")
    out = routing.expert_routes(candidates, routes)
    got = list(map(tuple, out.collect()))
    assert set(got) == want and len(got) == len(want) > 50
    assert not plan(out).startswith("Aggregate")


def test_routes_travel_as_arrays(spark, monkeypatch):
    """A row of each route went to each block of candidates; now an array does, which is unfolded after the join alone. Null ids stay."""
    monkeypatch.setattr(routing, "CLASS_BLOCK", 2)
    monkeypatch.setattr(routing, "ROUTE_BLOCK", 4)
    candidates = spark.range(11).selectExpr("if(id = 5, null, id) AS candidate_id", "'x' AS candidate_type", "array('a') AS kinds")
    routes = spark.range(30).selectExpr("if(id = 7, null, id) AS expert_id", "'m' AS modality", "'s' AS feature_space", "array('x') AS types", "array('a') AS kinds")
    out = routing.expert_routes(candidates, routes)
    got = list(map(tuple, out.collect()))
    want = {(c if c != 5 else None, e if e != 7 else None, "m", "s") for c in range(11) for e in range(30)}
    assert set(got) == want and len(got) == len(want)
    text = plan(out)
    assert 0 < text.index("explode(_routes") < text.index("Join") and "strategy=merge" in text


def test_receipts_of_one_field_are_not_one_task(spark):
    """Policies are sent to the receipts: a join by field put all receipts of a field into one task."""
    text = "field string, property_name string, validator_id string, policy_version string, unit string, methods array<string>, required_conditions array<string>, required_gates array<string>"
    policies = spark.createDataFrame([("f", "p", "v", "1", "u", ["m"], [], [])], text)
    receipts = spark.range(20).selectExpr(
        "id AS receipt_id", "'f' AS field", "'p' AS property_name", "'v' AS validator_id", "'1' AS policy_version", "if(id = 3, 'w', 'u') AS unit", "'m' AS method_id", "cast(array() AS array<string>) AS condition_keys",
        "'completed' AS execution_status", "0 AS exit_code", "'success' AS parser_status", "true AS qc_passed", "1 AS n_outputs", "1 AS n_convergence", "'h' AS output_sha256",
    )
    gates = spark.createDataFrame([], "receipt_id long, gate string, status string")
    usable = routing.usable_receipts(receipts, policies, gates)
    observed = receipts.selectExpr("receipt_id", "1 AS candidate_id", "field", "property_name", "validator_id", "unit", "true AS conditions_match", "1D AS value")
    profiles = spark.createDataFrame([("f", "p", ["v"], "u")], "field string, property_name string, validators array<string>, unit string")
    out = routing.field_results(observed, usable, profiles)
    assert "rightHint=(strategy=broadcast)" in plan(usable) and plan(out).count("strategy=broadcast") == 2
    assert tuple(out.select("n_accepted", "n_rejected", "status").first()) == (19, 1, "available")


def test_copies_are_one_value_of_a_front(spark, monkeypatch):
    """300 copies of 4 values in one group: no group is large."""
    monkeypatch.setattr(fronts, "SMALL", 2)
    monkeypatch.setattr(fronts, "MOST", 50)
    monkeypatch.setattr(fronts, "_large_fronts", lambda *a: pytest.fail("copies made a large group"))
    rows = spark.range(300).selectExpr("id", "'g' AS g", "cast(id % 4 AS double) AS v")
    got = fronts.all_fronts(rows, "id", "g", [(F.col("v"), F.col("v"))]).collect()
    assert len(got) == 300 and all(r.front == 4 - r.id % 4 for r in got)


@pytest.mark.parametrize("axes", [1, 2, 4])
def test_small_groups_at_once_equal_one_by_one(axes):
    rng = np.random.default_rng(axes)
    ids = rng.integers(0, 40, 600)
    worst = rng.integers(0, 6, (600, axes)).astype(float)
    best = worst + rng.integers(0, 3, (600, axes))
    got = fronts.small_levels(ids, worst, best)
    for g in set(ids):
        assert (got[ids == g] == fronts.chain_levels(worst[ids == g], best[ids == g])).all()


@pytest.mark.parametrize("block", [2048, 3])
def test_near_pairs_are_made_once_and_counted_by_class(spark, monkeypatch, block):
    monkeypatch.setattr(novelty, "NEAR_BLOCK", block)
    rng = random.Random(7)
    parts = [(i, rng.choice(["x", "y", None]), "t", rng.choice([1, 2, 3, 7, 8, 30, None]), rng.choice([100.0, 101.0, 103.0, 150.0, None])) for i in range(120)]

    class Tables:
        part = spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")

    want, counts = set(), {}
    for a, brand, _, sa, va in parts:
        for b, other, _, sb, vb in parts:
            if a < b and brand and brand == other:
                gap = None if sa is None or sb is None else abs(sa - sb)
                close = va is not None and vb is not None and abs(va - vb) / ((va + vb) / 2) <= 0.03
                relation = "distinct" if gap is None or gap > 5 else "strict" if close and gap <= 1 else "ambiguous" if close else "scaled"
                counts[brand, "t", relation] = counts.get((brand, "t", relation), 0) + 1
                want |= {(a, b, relation)} - {(a, b, "distinct")}
    pairs = novelty.near_pairs(Tables.part, F.col("p_partkey")).select(F.least("a", "b"), F.greatest("a", "b"), "relation").collect()
    assert set(map(tuple, pairs)) == want and len(pairs) == len(want)
    # 120 parts of 35 sizes and prices: the classes are paired, not the parts
    got = novelty.pair_counts(Tables)
    assert {(r.p_brand, r.p_type, r.relation): r.n_pairs for r in got.collect()} == counts


@pytest.mark.parametrize("block", [4096, 3])
def test_cover_of_two_axes_is_a_running_maximum(spark, monkeypatch, block):
    """Random sets against all pairs of members; no call of Python a set."""
    monkeypatch.setattr(control, "BLOCK", block)
    rng = random.Random(9)
    rows = [(k, r, float(rng.randrange(6)), float(rng.randrange(6))) for k in range(12) for r in (0, 1, 3) for _ in range(rng.randrange(1, 9))]
    out = control.cover(spark.createDataFrame(rows, "k long, r long, x double, y double"), ["k"], "r", ["x", "y"])
    of = lambda k, r: [p[2:] for p in rows if p[:2] == (k, r)]
    covers = lambda a, b: all(any(p[0] >= q[0] and p[1] >= q[1] for p in a) for q in b)
    want = {(k, r, None if before is None else covers(of(k, r), of(k, before)) - covers(of(k, before), of(k, r))) for k in range(12) for r, before in ((0, None), (1, 0), (3, 1))}
    assert set(map(tuple, out.collect())) == want and out.count() == len(want)
    assert "InPandas" not in plan(out)


def test_divisor_of_a_formula_is_computed_once(spark):
    df = spark.createDataFrame([({"H": 4.0, "O": 2.0},), ({"H": 1.5},)], "c map<string,double>")
    out = df.select(chemistry.reduced_formula(F.col("c")).alias("f"))
    assert [r.f for r in out.collect()] == ["H2O", None]
    assert plan(out).count("[1,2,3,4,5,6,7,8") <= 1


def test_few_criteria_and_requirements_are_sent(spark):
    rows = spark.range(9)
    assert "strategy=broadcast" in plan(rows.join(few(spark.range(3)), "id"))
    assert "strategy=broadcast" not in plan(rows.join(few(spark.range(30), 20), "id"))


def test_tokens_of_no_name_are_not_shuffled(spark):
    names = spark.createDataFrame([(1, "red cat"), (2, "dog")], "candidate_id long, name string")
    texts = spark.createDataFrame([(7, "A red cat."), (8, "red dogs cat"), (9, "hot dog")], "claim_id long, text string")
    out = claims.candidate_mentions(names, texts)
    assert set(map(tuple, out.collect())) == {(1, 7), (2, 9)}
    assert plan(out).count("LeftSemi") == 2
