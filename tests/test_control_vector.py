"""The eight control values against plain sets."""

import random

from assaylake.operators import evidence

REQUESTS = "candidate_id long, cycle int, expected array<string>, failed array<string>, previous_improvement double, collapse_rate double, alpha double, utility string"
FEATURES = "candidate_id long, expert_id string, status string, utility double"


def test_values(spark):
    rng = random.Random(7)
    requests = [(i, i % 5, rng.choice([None, [], ["a", "b", "z"]]), rng.choice([None, ["b"], ["a", "q"]]), rng.choice([None, -1.0, 0.0, 2.0]), 0.25, 0.5, "x") for i in range(60)]
    features = [(rng.randrange(66), rng.choice("abc"), rng.choice(["success", "success", "partial", "failed", None]), rng.choice([None, -0.5, 0.5])) for _ in range(150)]
    spread = [(i, 0.1 * i) for i in range(0, 60, 3)]
    got = evidence.control_vector(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(features, FEATURES), "utility", spark.createDataFrame(spread, "candidate_id long, disagreement double")).collect()
    assert len(got) == 60 and len({r.reason for r in got}) == 2
    for r in got:
        _, cycle, expected, failed, gain, *_ = requests[r.candidate_id]
        its = [f for f in features if f[0] == r.candidate_id]
        if not its:
            assert tuple(r)[1:] == (None,) * 8 + ("no_primary_feature",)
            continue
        good = {f[1] for f in its if f[2] == "success"}
        off = ({f[1] for f in its if f[2] == "partial"} | set(failed or []) | (set(expected or []) - {f[1] for f in its})) - good
        worst = min([f[3] for f in its if f[2] == "success" and f[3] is not None], default=0.0)
        assert tuple(r)[1:] == (cycle, len(good), len(off), worst, dict(spread).get(r.candidate_id, 0.0), float(gain is not None and gain > 0), 0.25, 0.5, None)
    empty = spark.createDataFrame([], REQUESTS), spark.createDataFrame([], FEATURES), "utility", spark.createDataFrame([], "candidate_id long, disagreement double")
    assert evidence.control_vector(*empty).collect() == []
