"""Mixing of sources to target weights by entropy balancing.

Token constraints fix how many words the mix takes of each source. Among all non-negative document
rates that meet them, the ones of least relative entropy to "every document once" are exponential
tilts exp(lambda of the source); lambda solves the convex dual, here by Newton iterations whose
gradient and Hessian are sums over all documents. Rates become whole copies: each document gets the
whole part, and a hash order within the source gives the fraction, cut where the taken words reach
the target, then mended by the one document that brings the sum closest to it.

Per-source tables are small against the documents; Spark broadcasts them only below its own size
threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import Scratch, materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS, BUCKET_ROWS = 12, 1 << 16  # of the hash order: at least so many buckets, so many rows a bucket
MENDS = 3


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source and size (words; null text: 0), with the number of equal rows."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def source_targets(units: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: water filling of share * all words by weight under cap * source size.

    Sources in code point order, null last, take the weights in turn. In order of size over weight the
    capped sources come first; the rest share what these leave by weight, which is where repeated
    resharing of the excess ends.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight)
        .withColumn("top", F.col("source_size") * cap)
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("before", F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
        .withColumn("capped", F.col("ratio") * F.sum("weight").over(onward) <= F.col("total") - F.col("before"))
        .withColumn("level", (F.col("total") - F.sum(F.when(F.col("capped"), F.col("top")).otherwise(0.0)).over(every)) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
        .select("source", "source_size", F.when(F.col("capped"), F.col("top")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def balance(units: DataFrame, targets: DataFrame, tolerance: float = 1e-12, rounds: int = 50) -> DataFrame:
    """targets with the dual's solution: source, source_size, target, tilt. A target of 0 has the tilt null.

    Each Newton round sums exp(tilt) * size over all documents of a source (integers first, so reruns agree): the gradient is that sum
    less the target, the (diagonal) Hessian the sum itself. Steps are held within 1, which keeps the
    first ones from running away; the rounds end when every relative gradient is within tolerance, and
    raise if it never is.
    """
    state = targets.withColumn("tilt", F.when(F.col("target") > 0, F.lit(0.0)))
    for _ in range(rounds):
        state = materialize(state, "tilt")
        taken = units.alias("u").join(state.select(F.col("source").alias("s"), "tilt"), F.col("u.source").eqNullSafe(F.col("s"))).groupBy("source").agg((F.sum(F.col("n") * F.col("size")) * F.exp(F.first("tilt"))).alias("taken"))
        both = state.join(taken.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        gradient = (F.col("taken") - F.col("target")) / F.col("taken")
        both = materialize(both.withColumn("gradient", F.when(F.col("target") > 0, gradient)), "tilt")
        if (both.agg(F.max(F.abs("gradient"))).first()[0] or 0.0) <= tolerance:
            return both.select("source", "source_size", "target", "tilt")
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gradient")))
        state = both.select("source", "source_size", "target", (F.col("tilt") - step).alias("tilt"))
    raise RuntimeError(f"the tilts didn't settle in {rounds} rounds")


def whole_copies(units: DataFrame, solved: DataFrame, seed: int) -> DataFrame:
    """units with source_size, target, rate and copies (rate rounded so that the sums meet the targets)."""
    bits = max(BUCKET_BITS, (units.count() // BUCKET_ROWS).bit_length())
    rate = F.coalesce(F.exp("tilt"), F.lit(0.0))
    whole = F.floor(F.col("rate") + 1e-9)
    chance = F.xxhash64(F.lit(seed), "doc_id", "size").bitwiseAND(F.lit((1 << 62) - 1))
    dealt = units.join(solved.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("whole", whole).withColumn("chance", chance).withColumn("bucket", F.shiftright("chance", 62 - bits))
    dealt = dealt.withColumn("mass", F.col("size") * F.col("n")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    # Where the hash order reaches the wanted words: first by buckets, then inside that bucket alone.
    sums = dealt.groupBy("source", "bucket", "want").agg(F.sum("mass").alias("in_bucket"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(below), F.lit(0)))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", (F.col("before") + F.col("in_bucket") <= F.col("want")).alias("inside"), (F.col("before") >= F.col("want")).alias("outside"))
    placed = materialize(dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b", "bucket"), "placed")
    edge = Window.partitionBy("source").orderBy("chance", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.where("not inside and not outside").withColumn("ahead", F.col("before") + F.coalesce(F.sum("mass").over(edge), F.lit(0)))
    at_edge = at_edge.withColumn("extra", (F.col("ahead") + F.col("mass") / 2 <= F.col("want")).cast("int")).drop("ahead")
    chosen = placed.where("inside or outside").withColumn("extra", F.col("inside").cast("int")).unionByName(at_edge).drop("inside", "outside", "before")
    for _ in range(MENDS):
        chosen = materialize(chosen, "chosen")
        missing = chosen.groupBy("source").agg((F.first("want") - F.sum(F.col("extra") * F.col("mass"))).alias("missing"))
        change = F.when(F.col("extra") == 1, -F.col("mass")).otherwise(F.col("mass"))
        both = chosen.join(missing.select(F.col("source").alias("s"), "missing"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        best = both.where("want > 0").groupBy("source").agg(F.min(F.struct(F.abs(F.col("missing") - change).alias("left"), F.col("chance").alias("c"), F.col("doc_id").alias("d"), F.col("size").alias("z"))).alias("best"), F.first("missing").alias("missing"))
        best = best.where("best.left < abs(missing)").select(F.col("source").alias("s"), F.col("best.c").alias("c"), F.col("best.d").alias("d"), F.col("best.z").alias("z"))
        hit = F.col("source").eqNullSafe(F.col("s")) & (F.col("chance") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
        chosen = chosen.join(best, hit, "left").withColumn("extra", F.when(F.col("c").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))).drop("s", "c", "d", "z")
    return chosen.select("doc_id", "source", "size", "n", "source_size", "target", "rate", (F.col("whole") + F.col("extra")).alias("copies"))


def mix_units(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per distinct (doc_id, source, size): n equal rows, source_size, target, rate, copies.

    Null texts have size 0; null sources are one source, the last; null ids are allowed. Rows that
    repeat an id with the same source and size share one decision. An empty table gives an empty
    result. No unit gets more than ``cap`` copies, rounded up; a source without words gets target 0.
    """
    with Scratch() as scratch:
        units = materialize(with_sizes(docs, id_col, text_col, source_col), "sizes")
        targets = source_targets(units, weights, share, cap)
        return scratch.keep(materialize(whole_copies(units, balance(units, targets), seed), "mix"))


def decisions(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (copies * size), rate, copies."""
    units = mix_units(docs, **options)
    rows = units.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_row", "n", "source")
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    units = mix_units(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    keys = units.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    # Both sides grow alike, so the plan is the same at every size: a merge join, never a broadcast of the decisions.
    taken = docs.join(keys.withColumnRenamed("copies", "_copies").hint("merge"), same)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
