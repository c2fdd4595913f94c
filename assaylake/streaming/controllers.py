"""Structured Streaming forms of the ordered folds and counters: controller, idempotent ingest, novelty, funnels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assaylake.operators.control import CONTROLS, START, Arms, Limits, allocate, bounded, step
from assaylake.sources.contracts import immutable_upsert


def scheduler_stream(observations: DataFrame, limits: Limits = Limits(), most: int = 1_000_000) -> DataFrame:
    """Controls after each observation, per branch, with the controls and the last round as state.

    observations: branch_id long, round_index long, objective_improvement, structural_collapse_rate double,
    high_disagreement boolean. Rounds are applied in order inside a batch; a round that isn't above the
    last applied one is late and comes out with the reason late_round, changing nothing.
    """
    schema = f"branch_id long, round_index long, {', '.join(f'{k} double' for k in CONTROLS)}, reasons string"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, *controls, collapse, recent = state.get
            now = {**dict(zip(CONTROLS, controls, strict=True)), "previous_collapse": collapse, "recent": tuple(recent)}
        else:
            last, now = -1, dict(START)
        rows = []
        for x in bounded(parts, most, "branch's batch").sort_values("round_index").itertuples():
            if x.round_index <= last:
                why = ["late_round"]
            else:
                now, why = step(now, x.objective_improvement, x.structural_collapse_rate, bool(x.high_disagreement), limits)
                last = x.round_index
            rows.append((key[0], x.round_index, *(now[k] for k in CONTROLS), ";".join(why)))
        state.update((int(last), *(now[k] for k in CONTROLS), now["previous_collapse"], list(now["recent"])))
        yield pd.DataFrame(rows, columns=["branch_id", "round_index", *CONTROLS, "reasons"])

    kept = f"last long, {', '.join(f'{k} double' for k in CONTROLS)}, collapse double, recent array<double>"
    return observations.groupBy("branch_id").applyInPandasWithState(fold, schema, kept, "append", GroupStateTimeout.NoTimeout)


def allocation_stream(observations: DataFrame, priorities: list[float], most: int = 1_000_000) -> DataFrame:
    """Upper-confidence allocation per bundle_id, with weights, uses and the last round as state.

    observations: bundle_id long, round_index long, objective_improvement, structural_collapse_rate double,
    failed boolean. A round that isn't above the last applied one gets no arm (null) and changes nothing.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, weights, used = state.get if state.exists else (-1, priorities, [0] * len(priorities))
        arms = Arms(list(weights), [int(n) for n in used])
        part = bounded(parts, most, "bundle's batch").sort_values("round_index", kind="stable", ignore_index=True)
        late = part[part["round_index"] <= last]
        rows = [(key[0], int(x), None, None) for x in late["round_index"]]
        rows += [(key[0], at, arm, weight) for at, _, arm, weight in allocate(part[part["round_index"] > last], arms, "round_index", None)]
        state.update((int(max(last, part["round_index"].max())), arms.weights, arms.used))
        yield pd.DataFrame(rows, columns=["bundle_id", "round_index", "arm", "weight"]).astype({"arm": "Int32"})

    return observations.groupBy("bundle_id").applyInPandasWithState(fold, "bundle_id long, round_index long, arm int, weight double", "last long, weights array<double>, used array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each kind in tumbling event-time windows; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def ingest(path: str, key: str, digest: str, on_conflict: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: inserts new keys into a Parquet table, skips known equal ones and hands conflicts on.

    Replaying a batch inserts nothing twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).option("ignoreMissingFiles", "true").parquet(path) if _exists(batch, path) else batch.limit(0)
        outcome = immutable_upsert(known, batch, key, digest)
        new = batch.join(outcome.where("outcome = 'insert'"), key, "left_semi").dropDuplicates([key])
        new.write.mode("append").parquet(path)
        if on_conflict is not None:
            on_conflict(outcome.where("outcome = 'conflict'"))

    return write


def _exists(frame: DataFrame, path: str) -> bool:
    spark = frame.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def history_novelty(arriving: DataFrame, history: DataFrame, fingerprint: str) -> DataFrame:
    """Stream-static join: each arriving row with whether the history holds its fingerprint."""
    known = history.select(F.col(fingerprint).alias("_f")).distinct()
    return arriving.join(known, F.col(fingerprint) == F.col("_f"), "left").withColumn("known", F.col("_f").isNotNull()).drop("_f")
