"""Paired runs against plain loops over odd rows."""

import random

from pyspark.sql import functions as F

from assaylake.operators import pairing

RUNS = "pair_id long, arm string, n_candidates long, seed string, runtime_hash string"
SLOTS = "pair_id long, arm string, pair_slot long, candidate_id long, stream_position long, batch_seed string, value double"


def plain(runs, slots):
    why = set()
    of = {a: [r for r in runs if r[1] == a] for a in pairing.ARMS}
    its = {a: [s for s in slots if s[1] == a] for a in pairing.ARMS}
    hashes = {a: of[a][0][4] if of[a] else None for a in pairing.ARMS}
    for a in pairing.ARMS:
        if len(of[a]) != 1:
            why.add(f"{a}_run_not_exactly_one")
        if not of[a] or sorted(s[2] for s in its[a]) != list(range(of[a][0][2])) or not its[a]:
            why.add(f"{a}_slots_missing_or_repeated")
        if of[a] and any(s[5] is None or s[5] != of[a][0][3] for s in its[a]):
            why.add(f"{a}_wrong_batch_seed")
    if None in hashes.values():
        why.add("runtime_not_attested")
    elif hashes["off"] != hashes["on"]:
        why.add("runtime_differs")
    by_slot = {}
    for s in slots:
        by_slot.setdefault(s[2], []).append(s)
    if any(len({s[1] for s in x}) == 1 for x in by_slot.values()):
        why.add("slot_sets_differ")
    if any(None in {s[4] for s in x} or len({s[4] for s in x}) > 1 for x in by_slot.values()):
        why.add("stream_positions_differ")
    return sorted(why)


def test_audit_and_deltas(spark):
    rng = random.Random(3)
    runs, slots = [], []
    for p in range(120):
        for a in pairing.ARMS:
            if rng.random() < 0.93:
                runs.append((p, a, 3, "s", rng.choice(["h"] * 12 + ["g", None])))
            picked = [0, 1, 2] if rng.random() < 0.85 else [rng.randrange(4) for _ in range(rng.randrange(4))]
            slots += [(p, a, s, 10 * p + s, s + (rng.random() < 0.02) if rng.random() > 0.01 else None, rng.choice(["s"] * 40 + ["t", None]), rng.random()) for s in picked]
    frames = spark.createDataFrame(runs, RUNS), spark.createDataFrame(slots, SLOTS)
    want = {p: plain([r for r in runs if r[0] == p], [s for s in slots if s[0] == p]) for p in {r[0] for r in runs}}
    assert {r.pair_id: r.reasons for r in pairing.audit_pairs(*frames).collect()} == want
    good = {p for p, why in want.items() if not why}
    assert 20 < len(good) < 100
    got = pairing.compare_pairs(*frames, {"gain": lambda off, on: on("value") - off("value")}).collect()
    value = {(p, a, s): v for p, a, s, *_, v in slots}
    assert {(r.pair_id, r.pair_slot): r.gain for r in got} == {(p, s): value[p, "on", s] - value[p, "off", s] for p in good for s in range(3)}
    assert pairing.compare_pairs(*[f.where(F.lit(False)) for f in frames], {}).collect() == []
