"""Operators on small hand-made tables with expected values."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import chemistry, control, evidence, novelty, screening, selection
from assaylake.operators import fronts as fronts_module
from assaylake.sources import contracts
from assaylake.streaming import controllers


def one(spark, column, **values):
    return spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_force_comparison(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.component_rmse(a, b), a="array(array(1D,2D,3D))", b="array(array(1D,2D,0D,99D))") == pytest.approx(3**0.5)
    many = {"a": "array_repeat(array(0D,0D,0D), 100)", "b": "concat(array(array(1D,0D,0D)), array_repeat(array(0D,0D,0D), 99))"}
    assert one(spark, S.component_rmse(a, b), **many) == pytest.approx((1 / 300) ** 0.5)
    assert one(spark, S.vector_rms(a, b), **many) == pytest.approx(0.1)
    assert one(spark, S.largest_vector_gap(a, b), **many) == 1.0
    assert one(spark, S.component_rmse(a, b), a="array(array(1D))", b="array()") is None


def test_scalars(spark):
    assert one(spark, S.sequence_distance(F.col("a"), F.col("b")), a="'ACDE'", b="'ACDF'") == 0.25
    assert one(spark, S.track_delta(F.col("a"), F.col("b")), a="array(1D, double('nan'), 2D)", b="array(2D, 3D, 9D)") == 1.0
    assert one(spark, S.fasta_sequence(F.col("a"), "ACDEF"), a="'>x\nacd\nef'") == "ACDEF"
    assert one(spark, S.fasta_sequence(F.col("a"), "ACDEF"), a="'>x\nac\n>y\nac'") is None
    assert one(spark, S.canonical_number(F.col("a")), a="'300.0'") == "300"
    assert one(spark, S.tri_state(F.col("a")), a="'maybe'") is None
    scales = one(spark, S.length_scales(F.col("a"), F.col("b")), a="'nm'", b="cast(null as string)")
    assert scales is None
    gate = [one(spark, S.interval_gate(F.lit(lo), F.lit(hi), F.lit(1.0), F.lit(2.0))) for lo, hi in ((1.1, 1.9), (0.5, 1.5), (2.5, 3.0))]
    assert gate == ["pass", "unknown", "fail"]
    assert one(spark, S.interval_gate(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"))) == "unknown"


def test_conformal_quantile(spark):
    rows = spark.createDataFrame([("s", x) for x in (0.11, 0.52, 0.19, 0.34, 0.27)] + [("t", 1.0)] * 3, "scope string, score double")
    got = {r.scope: r for r in selection.conformal_quantile(rows, "scope", "score", 0.2).collect()}
    assert (got["s"]["rank"], got["s"]["quantile"], got["s"]["reason"]) == (5, 0.52, None)
    assert (got["t"]["quantile"], got["t"]["reason"]) == (None, "calibration_set_too_small") or got["t"]["rank"] <= 3
    with pytest.raises(ValueError):
        selection.conformal_rank(3, 0.01)


def test_relative_energy_keeps_under_offsets(spark):
    rows = [("a", "X", 1.0, 5.0, "k"), ("b", "X", 2.0, 7.0, "k"), ("c", "Y", 1.0, 1.0, "k")]
    schema = "id string, comp string, e0 double, e1 double, al string"
    run = lambda d: {r.id: r for r in screening.relative_energy(spark.createDataFrame(d, schema), "id", "comp", "e0", "e1", "al").collect()}
    got, moved = run(rows), run([(i, c, x + 100, y - 50, k) for i, c, x, y, k in rows])
    assert got["b"].energy_difference == 1.0 and {k: v.energy_difference for k, v in got.items()} == {k: v.energy_difference for k, v in moved.items()}
    assert got["c"].status == "unknown" and got["c"].reasons == ["singleton_composition_pool"] and got["c"].escalate


def test_fronts_crowding_and_large_groups(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "c", -3.0, -1.0), (2, "c", -2.0, -2.0), (3, "c", -1.0, -3.0), (4, "d", -100.0, 0.0), (5, "c", 0.0, 0.0)], "id long, comp string, x double, y double")
    for block in (2048, 1):
        monkeypatch.setattr(fronts_module, "MOST", block)
        monkeypatch.setattr(fronts_module, "BLOCK", block)
        fronts = screening.pareto_fronts(rows, "id", "comp", ["x", "y"])
        assert {r.id: r.front for r in fronts.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    out = {r.id: r for r in screening.crowding(rows.join(fronts, "id").where("front = 1"), "id", ["comp", "front"], ["x", "y"]).collect()}
    assert [out[i].boundary for i in (1, 2, 3, 4)] == [True, False, True, True] and out[2].crowding == 2.0


def test_portfolio(spark):
    rows = [(1, "Li-O", 1, True, False), (2, "Li-O", 2, True, False), (3, "Na-Cl", 3, True, False)]
    schema = "id long, comp string, rank long, eligible boolean, escalate boolean"
    assert {r.id for r in screening.portfolio(spark.createDataFrame(rows, schema), "id", "comp", 2).collect()} == {1, 3}
    forced = screening.portfolio(spark.createDataFrame([*rows, (4, "Li-O", 4, True, True)], schema), "id", "comp", 2).collect()
    assert sorted((r.id, r.slot) for r in forced) == [(1, 1), (4, 2)]
    with pytest.raises(ValueError):
        screening.portfolio(spark.createDataFrame(rows, schema), "id", "comp", 6)


def test_first_front_is_scoped(spark):
    rows = spark.createDataFrame([(1, "A", 1.0, 9.0), (2, "A", 1.0, 5.0), (3, "B", 1.0, 1.0), (4, "B", 0.5, 0.0)], "id long, scope string, size double, price double")
    got = {r.id for r in selection.first_front(rows, "id", ["size"], ["price"], "scope").collect()}
    assert got == {1, 3}


def test_reserved_slot(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "candidate_id string, slot long")
    pool = spark.createDataFrame([("a", "match", 1), ("b", "unknown", 2), ("c", "no_match", 3)], "candidate_id string, status string, rank long")
    assert sorted((r.candidate_id, r.slot, r.reserved) for r in novelty.reserve_slot(base, pool, 2).collect()) == [("a", 1, False), ("c", 2, True)]
    assert {r.candidate_id for r in novelty.reserve_slot(base, pool, 1).collect()} == {"a", "b"}


def test_mixed_units_and_upsert(spark):
    rows = spark.createDataFrame([("p", 1.0, "eV", "a"), ("p", 3.0, None, "b"), ("q", 1.0, "eV", "b"), ("q", 3.0, "eV", "a")], "k string, v double, u string, s string")
    got = {r.k: r for r in evidence.property_aggregate(rows, ["k"], "v", "u", "s").collect()}
    assert (got["p"].mean_value, got["p"].warning) == (None, "mixed_units") and got["q"].mean_value == 2.0
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, digest string")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n"), (4, "a"), (4, "b")], "id long, digest string")
    assert {r.id: r.outcome for r in contracts.immutable_upsert(old, new, "id", "digest").collect()} == {1: "unchanged", 2: "conflict", 3: "insert", 4: "conflict"}


def test_formulas(spark):
    parse = chemistry.formula_counts
    assert parse("Fe2(SO4)3")[0] == {"Fe": 2.0, "S": 3.0, "O": 12.0} and list(parse("Fe2(SO4)3")[0]) == ["O", "S", "Fe"]
    assert parse("Li0.5CoO2")[0] == {"Li": 0.5, "Co": 1.0, "O": 2.0} and parse("Li.5 Co")[0] == {"Li": 0.5, "Co": 1.0}
    broken = {"": "empty_formula", None: "empty_formula", "Fe)": "unbalanced_brackets", "(Fe": "unbalanced_brackets", "fe": "unknown_character", "Fe0": "misplaced_or_zero_amount", "2Fe": "misplaced_or_zero_amount", "Xx2O3": "unknown_element", "Zz": "unknown_element", "[Fe]": "unknown_character", "()": "empty_formula"}
    assert {f: parse(f)[1] for f in broken} == broken
    frame = spark.createDataFrame([({"Fe": 4.0, "O": 6.0},), ({"Li": 0.5},), ({"H": 2.0, "O": 1.0},)], "m map<string,double>")
    found = frame.select(chemistry.reduced_formula(F.col("m")).alias("r"), chemistry.chemical_system(F.map_keys("m"), 2).alias("s")).collect()
    assert [tuple(x) for x in found] == [("Fe2O3", "Fe-O"), (None, None), ("H2O", "H-O")]
    kinds = "key string, reduced string, reps array<struct<kind string, canonical boolean, value string>>, formulas array<string>"
    rows = [("K 1", "R", [], ["F"]), (" ", "R", [], ["F"]), (None, None, [("formula", False, "x"), ("formula", True, "C O")], ["F"]), (None, "", [], ["F"]), (None, None, [], [])]
    scope = spark.createDataFrame(rows, kinds).select(chemistry.composition_scope(*map(F.col, ("key", "reduced", "reps", "formulas"))))
    assert [x[0] for x in scope.collect()] == ["K1", "R", "CO", "F", None]


def test_scheduler_step():
    def run(observations, limits=control.Limits()):
        state, out = control.START, []
        for improvement, collapse, disagreement in observations:
            state, why = control.step(state, improvement, collapse, disagreement, limits)
            out.append((tuple(state[k] for k in control.CONTROLS), why))
        return out

    assert run([(0.1, 0.0, False), (0.2, 0.0, False)])[-1] == ((0.4, 1.0, 0.2, 0.3), ["sustained_improvement"])
    assert run([(0.0, 0.5, False)])[-1][1] == ["no_trend"]  # a first collapse has none before it
    cooled = run([(0.1, 0.0, False), (0.2, 0.5, False)])[-1]
    assert cooled == ((0.5, 0.8, 0.1, 0.3), ["collapse_increased"])  # and sustained improvement doesn't count then
    assert run([(0.1, 0.0, False), (0.2, 5e-7, False)])[-1][1] == ["sustained_improvement"]  # within the tolerance
    assert run([(-1.0, 0.0, False), (-2.0, 0.0, False)])[-1][1] == ["no_trend"]  # worse isn't stagnant
    explored = run([(0.0, 0.0, False), (1e-10, 0.0, True)])[-1]
    assert explored == ((0.5, 1.2, 0.3, 0.4), ["stagnation", "disagreement"])
    guided = control.Limits(guided=True)
    assert run([(0.1, 0.0, False), (0.2, 0.0, False)], guided)[-1][0][0] == 0.6
    assert run([(0.0, 0.0, False), (0.0, 0.0, False)], guided)[-1][0] == (0.4, 1.2, 0.3, 0.35)
    assert run([(0.0, 0.0, False), (0.0, 0.5, False)], guided)[-1][0] == (0.4, 0.8, 0.1, 0.3)
    assert run([(0.0, 0.0, True)] * 200)[-1][0] == (0.5, 5.0, 1.0, 1.0)


def test_allocation(spark):
    """Against a plain loop: first weights are priorities, failures count, workers of a round share one state."""
    rng = random.Random(3)
    rows = [(b, r, w, rng.uniform(-2, 2), rng.random(), rng.random() < 0.3) for b in (1, 2) for r in range(30) for w in ("x", "y")]
    frame = spark.createDataFrame(rows, "bundle_id long, round_index long, worker string, objective_improvement double, structural_collapse_rate double, failed boolean")
    first = [0.9, 0.65, 0.6]
    got = {(r.bundle_id, r.round_index, r.worker): (r.arm, r.weight) for r in control.allocation_trace(frame, "bundle_id", first, worker="worker").collect()}
    for b in (1, 2):
        weight, used = list(first), [0, 0, 0]
        for r in range(30):
            chosen = {}
            for w in ("x", "y"):
                score = [weight[i] + math.sqrt(2 * math.log(2 + sum(used)) / (used[i] + 1)) for i in range(3)]
                chosen[w] = score.index(max(score))
                used[chosen[w]] += 1
            for _, _, w, gain, collapse, failed in (x for x in rows if x[:2] == (b, r)):
                arm = chosen[w]
                weight[arm] = min(1.5, max(0.0, weight[arm] + 0.2 * max(-1, min(1, gain)) - 0.35 * collapse - 0.5 * failed))
                assert got[b, r, w] == (arm, round(weight[arm], 9))
    with pytest.raises(Exception, match="more than 10 observations"):
        control.allocation_trace(frame, "bundle_id", first, worker="worker", most=10).collect()


def test_allocation_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(b, r, rng.uniform(-2, 2), rng.random(), rng.random() < 0.3) for b in (1, 2) for r in range(1, 13)]
    frame = spark.createDataFrame(rows, "bundle_id long, round_index long, objective_improvement double, structural_collapse_rate double, failed boolean")
    for low, high in ((0, 5), (5, 12)):
        frame.where(f"round_index > {low} and round_index <= {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = controllers.allocation_stream(stream, [0.9, 0.8]).writeStream.format("memory").queryName("arms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = control.allocation_trace(frame, "bundle_id", [0.9, 0.8])
    assert sorted(map(tuple, spark.table("arms").collect())) == sorted(map(tuple, want.collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(b, r, float((r * b) % 3 - 1), float(r % 2), r % 5 == 0) for b in (1, 2) for r in range(1, 9)]
    schema = "branch_id long, round_index long, objective_improvement double, structural_collapse_rate double, high_disagreement boolean"
    frame = spark.createDataFrame(rows, schema)
    for low, high in ((0, 4), (4, 9)):
        frame.where(f"round_index > {low} and round_index <= {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = controllers.scheduler_stream(stream).writeStream.format("memory").queryName("trace").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("trace").collect()))
    assert got == sorted(map(tuple, control.scheduler_trace(frame).collect()))


def test_ingest_is_idempotent(spark, tmp_path):
    seen = []
    write = controllers.ingest(str(tmp_path / "t"), "id", "digest", lambda c: seen.extend(r.id for r in c.collect()))
    first = spark.createDataFrame([(1, "x"), (2, "y")], "id long, digest string")
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([(2, "z"), (3, "n")], "id long, digest string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "x"), (2, "y"), (3, "n")] and seen == [2]


def test_typed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "v": 2.5}\n{"id": "x", "v": 1}\n{"id": 2, "w": 1}\nnot json\n')
    got = contracts.read_json(spark, str(tmp_path), spark.createDataFrame([], "id long, v double").schema).collect()
    assert [r.status for r in got].count("valid") == 1 and {x for r in got for x in r.reasons} >= {"unknown_field", "wrong_type", "not_an_object"}
    assert pd.Series([r.id for r in got if r.status == "valid"]).tolist() == [1]
