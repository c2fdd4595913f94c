"""Identity and novelty: duplicates, history and snapshot matches, status algebra, reserved slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_duplicates(rows: DataFrame, entity: str, fingerprint: str) -> DataFrame:
    """entity, first (the least id with the fingerprint), copies and whether the row is a duplicate; counts, not pairs."""
    groups = rows.groupBy(fingerprint).agg(F.min(entity).alias("first"), F.count("*").alias("copies"))
    return rows.select(entity, fingerprint).join(groups, fingerprint).select(entity, "first", "copies", (F.col(entity) != F.col("first")).alias("duplicate"))


def history_matches(rows: DataFrame, history: DataFrame, fingerprint: str) -> DataFrame:
    """rows with the number of history rows of the same fingerprint and the least of them."""
    seen = history.groupBy(fingerprint).agg(F.min("history_id").alias("matched_id"), F.count("*").alias("n_matches"))
    return rows.join(seen, fingerprint, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def snapshot_status(matches: DataFrame, provider_complete: DataFrame, entity: str) -> DataFrame:
    """match if a row matched; no_match only from a complete provider; else unknown."""
    out = matches.join(provider_complete, "provider", "left")
    status = F.when(F.col("matched") & F.col("complete"), "match").when(~F.col("matched") & F.coalesce("complete", F.lit(False)), "no_match").otherwise("unknown")
    return out.select(entity, "provider", status.alias("status"))


def status_algebra(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Any match is a match, all no_match is no_match, anything else unknown."""
    return rows.groupBy(*keys).agg(F.when(F.max((F.col(status) == "match").cast("int")) == 1, "match").when(F.min((F.col(status) == "no_match").cast("int")) == 1, "no_match").otherwise("unknown").alias("status"))


def pair_relation(volume_gap, lattice_gap, angle_gap):
    """strict, scaled, ambiguous or distinct from relative gaps; a volume gap above 3 % rules strict out."""
    strict = (volume_gap <= 0.03) & (lattice_gap <= 0.02) & (angle_gap <= 1.0)
    scaled = (lattice_gap <= 0.2) & (angle_gap <= 5.0)
    return F.when(strict, "strict").when(scaled & (volume_gap <= 0.03), "ambiguous").when(scaled, "scaled").otherwise("distinct")


def reserve_slot(base: DataFrame, eligible: DataFrame, top_k: int) -> DataFrame:
    """(candidate_id, slot, reserved): the base ranking, with one eligible external no-match put in if none is there.

    base has candidate_id and slot up to top_k; the no-match takes a free slot, else the last one.
    """
    if top_k < 2:
        return base.select("candidate_id", "slot", F.lit(False).alias("reserved"))
    best = eligible.where("status = 'no_match'").orderBy("rank").limit(1).select(F.col("candidate_id").alias("r"))
    state = base.join(best, F.col("candidate_id") == F.col("r"), "left").agg(F.count("*").alias("n"), F.count("r").alias("has"))
    extra = best.join(state.where("has = 0"), F.lit(True)).select(F.col("r").alias("candidate_id"), F.least(F.col("n") + 1, F.lit(top_k)).cast("long").alias("slot"), F.lit(True).alias("reserved"))
    kept = base.select("candidate_id", "slot", F.lit(False).alias("reserved")).join(extra.select(F.col("slot").alias("_s")), F.col("slot") == F.col("_s"), "left_anti")
    return kept.unionByName(extra)
