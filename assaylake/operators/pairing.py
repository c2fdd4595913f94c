"""Paired runs: an audit of each pair's two arms, and slot by slot deltas of the pairs that pass it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import reasons

ARMS = ("off", "on")


def audit_pairs(runs: DataFrame, slots: DataFrame) -> DataFrame:
    """pair_id and reasons (none: the pair may be compared).

    runs: pair_id, arm (off or on), n_candidates, seed, runtime_hash, a row each. slots: pair_id, arm,
    pair_slot, stream_position, batch_seed, a row a candidate. Each arm must have one run and exactly the
    slots 0 to n_candidates - 1, all drawn with its seed; both arms must have the same slots at the same
    stream positions and equal, attested runtime parameters. Slots without a run aren't a pair.
    """
    one = {}
    for arm in ARMS:
        of = F.col("arm") == arm
        one |= {f"{arm}_n": F.count_if(of), **{f"{arm}_{c}": F.max(F.when(of, F.col(c))) for c in ("n_candidates", "seed", "runtime_hash")}}
    both = runs.groupBy("pair_id").agg(*[c.alias(n) for n, c in one.items()])
    seeds = runs.groupBy("pair_id", "arm").agg(F.max("seed").alias("_seed"))
    have = slots.join(seeds, ["pair_id", "arm"]).groupBy("pair_id", "arm").agg(
        F.count("*").alias("n"), F.countDistinct("pair_slot").alias("d"), F.min("pair_slot").alias("low"), F.max("pair_slot").alias("high"), F.max((~F.coalesce(F.col("batch_seed") == F.col("_seed"), F.lit(False))).cast("int")).alias("wrong")
    )
    for arm in ARMS:
        both = both.join(have.where(F.col("arm") == arm).select("pair_id", *[F.col(c).alias(f"{arm}_{c}_") for c in ("n", "d", "low", "high", "wrong")]), "pair_id", "left")
    # Slots of either arm by (pair, slot): what is on one side alone, or elsewhere in the stream.
    side = F.when(F.col("arm") == "off", 1).when(F.col("arm") == "on", 2)
    meet = slots.groupBy("pair_id", "pair_slot").agg(F.min(side).alias("a"), F.max(side).alias("b"), F.min("stream_position").alias("p"), F.max("stream_position").alias("q"), F.count("*").alias("n"), F.count("stream_position").alias("k"))
    off = meet.groupBy("pair_id").agg(F.max((F.col("a") == F.col("b")).cast("int")).alias("_alone"), F.max(((F.col("p") != F.col("q")) | (F.col("k") < F.col("n"))).cast("int")).alias("_moved"))
    both = both.join(off, "pair_id", "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    whole = lambda arm: true((F.col(f"{arm}_n_") == F.col(f"{arm}_n_candidates")) & (F.col(f"{arm}_d_") == F.col(f"{arm}_n_")) & (F.col(f"{arm}_low_") == 0) & (F.col(f"{arm}_high_") == F.col(f"{arm}_n_") - 1))
    hashes = F.col("off_runtime_hash"), F.col("on_runtime_hash")
    rules = {f"{arm}_run_not_exactly_one": F.col(f"{arm}_n") != 1 for arm in ARMS}
    rules |= {f"{arm}_slots_missing_or_repeated": ~whole(arm) for arm in ARMS} | {f"{arm}_wrong_batch_seed": true(F.col(f"{arm}_wrong_") == 1) for arm in ARMS}
    rules |= {"runtime_not_attested": hashes[0].isNull() | hashes[1].isNull(), "runtime_differs": true(hashes[0] != hashes[1]), "slot_sets_differ": true(F.col("_alone") == 1), "stream_positions_differ": true(F.col("_moved") == 1)}
    return both.select("pair_id", reasons(**rules).alias("reasons"))


def compare_pairs(runs: DataFrame, slots: DataFrame, deltas: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]]) -> DataFrame:
    """A row per pair_slot of the pairs without reasons: pair_id, pair_slot, off_candidate, on_candidate and the deltas.

    slots has candidate_id and what the deltas use; a delta gets two functions that name a column of the
    off and of the on side, and is null where one of them is.
    """
    good = audit_pairs(runs, slots).where(F.size("reasons") == 0).select("pair_id")
    side = lambda arm: slots.where(F.col("arm") == arm).select("pair_id", "pair_slot", F.struct(*[c for c in slots.columns if c not in ("pair_id", "arm", "pair_slot")]).alias(arm))
    both = side("off").join(side("on"), ["pair_id", "pair_slot"]).join(good, "pair_id", "left_semi")
    of = lambda arm: lambda c: F.col(f"{arm}.{c}")
    return both.select("pair_id", "pair_slot", F.col("off.candidate_id").alias("off_candidate"), F.col("on.candidate_id").alias("on_candidate"), *[f(of("off"), of("on")).alias(n) for n, f in deltas.items()])
