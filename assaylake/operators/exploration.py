"""Selection of parents by five branches: stability, target, diversity, disagreement and the Pareto front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.selection import disagreement_top_k, top_k

FALLBACK = "generation_prior_only_no_stability_evidence"


def explore(rows: DataFrame, entity: str, by: str, k: int, threshold: float = 0.0) -> DataFrame:
    """(by, branch, rank, entity, score, reason): the best k of each branch in each pool ``by``.

    rows: entity, by, and as doubles stability, target, diversity and disagreement (null where unknown),
    and pareto (whether nothing dominates the row). The Pareto branch ranks its rows by target. The
    disagreement branch keeps its last place for one row whose disagreement is unknown. Where a pool has
    no stability score at all, its best row of the Pareto front by target (of all rows if none is on it)
    stands in that branch with a null score and a reason. Rows without the score of a branch aren't in
    it; ties go by entity; rows of a null pool are a pool; an empty table gives no rows.
    """
    pooled = rows.select(F.struct(F.col(by).alias("p")).alias("_p"), entity, *[F.col(c).cast("double").alias(c) for c in ("stability", "target", "diversity", "disagreement")], F.coalesce("pareto", F.lit(False)).alias("pareto"))

    def best(branch: str, score: str, part: DataFrame) -> DataFrame:
        ranked = top_k(part.where(F.col(score).isNotNull()), ["_p"], [F.desc(score), F.col(entity)], k)
        return ranked.select("_p", F.lit(branch).alias("branch"), "rank", entity, F.col(score).alias("score"), F.lit(None).cast("string").alias("reason"))

    scored = pooled.groupBy("_p").agg(F.count("stability").alias("_n")).where("_n = 0").select("_p")
    bare = pooled.join(scored, "_p", "left_semi")
    stand_in = top_k(bare, ["_p"], [F.desc("pareto"), F.col("target").desc_nulls_last(), F.col(entity)], 1)
    stand_in = stand_in.select("_p", F.lit("stability").alias("branch"), "rank", entity, F.lit(None).cast("double").alias("score"), F.lit(FALLBACK).alias("reason"))
    unsure = disagreement_top_k(pooled.select("_p", entity, F.col("disagreement").alias("score")), entity, "_p", threshold, k)
    unsure = unsure.join(pooled.select("_p", entity, F.col("disagreement").alias("score")), ["_p", entity])
    unknown = F.when(F.col("score").isNull(), "disagreement_unknown")
    unsure = unsure.select("_p", F.lit("disagreement").alias("branch"), "rank", entity, "score", unknown.alias("reason"))
    out = best("stability", "stability", pooled).unionByName(stand_in).unionByName(best("target", "target", pooled)).unionByName(best("diversity", "diversity", pooled))
    out = out.unionByName(unsure).unionByName(best("pareto", "target", pooled.where("pareto")))
    return out.select(F.col("_p.p").alias(by), "branch", "rank", entity, "score", "reason")
