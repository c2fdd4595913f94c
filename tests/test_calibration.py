"""Set containment and calibration scopes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import calibration

REQUEST = "candidate_id long, scope_id string, elements array<string>, composition string, revisions string, method string, reference_hash string, proxy_name string, unit string, value double, artifact_id string"
ARTIFACT = "artifact_id string, scope_id string, allowed_elements array<string>, allowed_compositions array<string>, revisions string, method string, reference_hash string, proxy_name string, unit string, quantile double, coverage double"


def plain(request, artifacts):
    """(artifact, reasons) of a request as named tuples' dictionaries."""
    scoped = [a for a in artifacts if a["scope_id"] == request["scope_id"] is not None]
    inside = lambda a: request["elements"] is not None and None not in request["elements"] and a["allowed_elements"] is not None and set(request["elements"]) <= set(a["allowed_elements"])
    listed = lambda a: not a["allowed_compositions"] or request["composition"] in a["allowed_compositions"]
    same = lambda a, *keys: all(a[k] == request[k] is not None for k in keys)
    whole = [a["artifact_id"] for a in scoped if inside(a) and listed(a) and same(a, *calibration.EXACT, "unit")]
    if whole:
        return min(whole), []
    if not scoped:
        return None, ["exchangeability_scope_id_mismatch"]
    why = [r for k, r in calibration.EXACT.items() if not any(same(a, k) for a in scoped)]
    why += ["chemistry_elements_out_of_scope"] * (not any(map(inside, scoped))) + ["reduced_composition_out_of_scope"] * (not any(map(listed, scoped)))
    why += ["proxy_unit_mismatch"] * (any(same(a, "proxy_name") for a in scoped) and not any(same(a, "proxy_name", "unit") for a in scoped))
    return None, sorted(why) or ["no_single_artifact"]


@pytest.mark.parametrize("seed", [1, 2])
def test_scopes_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    some = lambda *xs: rng.choice(xs)
    artifacts = [
        (f"a{i:02}", some("s1", "s2", "s2"), rng.sample(["Li", "O", "Fe", "Na", "Cl"], rng.randrange(0, 6)) if i % 9 else None, some(None, [], ["LiO", "NaCl"], ["FeO"]), some("r1", "r2"), some("m1", "m2"), "h1", some("energy", "gap"), some("eV", "meV"), i / 10, 0.9)
        for i in range(40)
    ]
    requests = [
        (i, some("s1", "s2", "s2", "s3", None), rng.sample(["Li", "O", "Fe", "Na", "X"], rng.randrange(0, 4)) if i % 8 else some(None, ["Li", None]), some("LiO", "FeO", "XX", None), some("r1", "r2", "r3"), some("m1", "m2", None), some("h1", "h1", "h2"), some("energy", "gap", "gap", "none"), some("eV", "meV", "J"), float(i), "clash")
        for i in range(150)
    ] * 2  # repeated rows
    schema = lambda s: [c.split()[0] for c in s.split(", ")]
    listed = [dict(zip(schema(ARTIFACT), a, strict=True)) for a in artifacts]
    got = calibration.assess_proxies(spark.createDataFrame(requests, REQUEST).drop("artifact_id"), spark.createDataFrame(artifacts, ARTIFACT)).collect()
    assert len(got) == len(requests)
    want = {r[0]: plain(dict(zip(schema(REQUEST), r, strict=True)), listed) for r in requests}
    assert any(a for a, _ in want.values())
    for r in got:
        assert (r.artifact_id, r.reasons) == want[r.candidate_id], r
        quantile = next((a["quantile"] for a in listed if a["artifact_id"] == r.artifact_id), None)
        assert (r.lower_bound, r.upper_bound) == ((None, None) if quantile is None else (r.candidate_id - quantile, r.candidate_id + quantile))


def test_empty_tables(spark):
    requests, artifacts = spark.createDataFrame([(1, "s", [], "c", "r", "m", "h", "p", "u", 1.0, None)], REQUEST), spark.createDataFrame([("a", "s", [], None, "r", "m", "h", "p", "u", 0.5, None)], ARTIFACT)
    assert calibration.assess_proxies(requests.limit(0), artifacts).collect() == []
    assert [r.reasons for r in calibration.assess_proxies(requests, artifacts.limit(0)).collect()] == [["exchangeability_scope_id_mismatch"]]
    assert [(r.artifact_id, r.reasons) for r in calibration.assess_proxies(requests, artifacts).collect()] == [("a", [])]


def test_probes_meet_their_rarest_element_alone(spark):
    """A common element of all sets costs nothing where a rarer one is asked for too."""
    sets = spark.range(2000).select(F.col("id").alias("owner"), F.when(F.col("id") == 7, F.array(F.lit("common"), F.lit("rare"))).otherwise(F.array(F.lit("common"))).alias("allowed"), F.lit(1).alias("k"))
    probes = spark.createDataFrame([(i, ["common", "rare"], 1) for i in range(50)], "key long, elements array<string>, k int")
    assert {(r.key, r.owner) for r in calibration.set_containment(probes, sets, ["k"], "key", "elements", "owner", "allowed").collect()} == {(i, 7) for i in range(50)}
