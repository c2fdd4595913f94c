"""Arrivals: novelty against history and the stream itself, sessions, late rows, and rounds that several workers share."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assaylake.operators.control import Arms, allocate
from assaylake.session import ship_package

STATUS = "CASE WHEN history_id IS NOT NULL THEN 'history' WHEN first_id <> {entity} THEN 'stream' ELSE 'new' END"


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The stream with a watermark; times without a zone are taken in the session's."""
    ship_package(stream.sparkSession)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def _with_history(arriving: DataFrame, history: DataFrame, fingerprint: str) -> DataFrame:
    """arriving with the least history_id of the same fingerprint."""
    known = history.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("_f")).agg(F.min("history_id").alias("history_id"))
    return arriving.join(known, F.col(fingerprint) == F.col("_f"), "left").drop("_f")


def arrival_novelty(arriving: DataFrame, history: DataFrame, entity: str, fingerprint: str, time: str, keep: timedelta) -> DataFrame:
    """entity, first_id, history_id and status of each arrival, in the order of time and entity (the batch twin of the stream).

    first_id is the first holder of the fingerprint among arrivals that follow each other in less than
    ``keep``: after a longer pause a fingerprint is new again. status is history (the history holds it),
    stream (another arrival came first) or new. Arrivals without a fingerprint are each their own.
    """
    by = Window.partitionBy(fingerprint).orderBy(time, entity)
    pause = _micros(F.col(time)) - _micros(F.lag(time).over(by))
    begins = (F.col(fingerprint).isNull() | pause.isNull() | (pause >= int(keep.total_seconds() * 1e6))).cast("long")
    run = Window.partitionBy(fingerprint, "_run").orderBy(time, entity)
    rows = _with_history(arriving.select(entity, fingerprint, time), history, fingerprint)
    numbered = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(by))
    return numbered.withColumn("first_id", F.first(entity).over(run)).select(entity, "first_id", "history_id", F.expr(STATUS.format(entity=entity)).alias("status"))


def novelty_stream(arriving: DataFrame, history: DataFrame, entity: str, fingerprint: str, time: str, keep: timedelta, late: str = "1 minute") -> DataFrame:
    """Streaming twin of arrival_novelty: the first holder of each fingerprint is state beside the static history.

    Arrivals are taken in the order of batches, and of time and entity inside one. State expires when the
    watermark (``late`` behind) has passed a fingerprint's last arrival by ``keep``. Arrivals without a
    fingerprint get none of their own state: they should be told apart before.
    """
    kept_ms = int(keep.total_seconds() * 1000)
    kind = arriving.schema[entity].dataType.simpleString()
    told = _timed(arriving.where(F.col(fingerprint).isNotNull()), time, late)
    rows = _with_history(told, history, fingerprint).select(F.col(fingerprint).alias("_f"), F.col(entity).alias("_e"), "history_id", F.unix_millis(time).alias("_ms"), F.col(time).alias("_t"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last = state.get if state.exists else (None, None)
        found = []
        for x in pd.concat(list(parts), ignore_index=True).sort_values(["_ms", "_e"]).itertuples(index=False):
            entity_id, history_id, ms = x[1], x[2], int(x[3])
            if last is None or ms - last >= kept_ms:
                first = entity_id
            last = ms if last is None else max(last, ms)
            history_id = None if pd.isna(history_id) else int(history_id)
            found.append((entity_id, first, history_id, "history" if history_id is not None else "new" if first == entity_id else "stream"))
        if last + kept_ms <= state.getCurrentWatermarkMs():
            state.remove()
        else:
            state.update((first, last))
            state.setTimeoutTimestamp(last + kept_ms)
        yield pd.DataFrame(found, columns=[entity, "first_id", "history_id", "status"]).astype({"history_id": "Int64"})

    return rows.groupBy("_f").applyInPandasWithState(fold, f"{entity} {kind}, first_id {kind}, history_id long, status string", f"first {kind}, last long", "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(events: DataFrame, time: str, key: str, kind: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A row per session of a key (events less than ``gap`` apart): begin, last end, events and those of each kind as a map.

    On a stream sessions come out once the watermark has passed them; what comes later is left out of
    them (see late_rows). Events without time or key are left out.
    """
    known = events.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    timed = _timed(known, time, late) if events.isStreaming else known
    counted = timed.groupBy(F.session_window(time, gap).alias("_s"), key).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == "error").alias("n_errors"))
    return counted.select(key, F.col("_s.start").alias("begin"), F.col("_s.end").alias("end"), "n", "n_errors")


def late_rows(events: DataFrame, time: str, late: str = "2 hours", buckets: int = 64) -> DataFrame:
    """The stream's rows that came after the watermark had passed them, which windows of it leave out."""
    columns = events.columns
    schema = ", ".join(f"`{f.name}` {'timestamp' if f.name == time else f.dataType.simpleString()}" for f in events.schema.fields)

    def pick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        for part in parts:
            yield part[part["_ms"] < mark][columns]

    marked = _timed(events, time, late).withColumn("_ms", F.unix_millis(time)).withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    return marked.groupBy("_bucket").applyInPandasWithState(pick, schema, "n long", "append", GroupStateTimeout.NoTimeout)


OBSERVED = ["round_index", "worker", "_ms", "objective_improvement", "structural_collapse_rate", "failed"]


def shared_allocation_stream(observations: DataFrame, priorities: list[float], workers: int, wait: timedelta = timedelta(minutes=10), late: str = "1 minute") -> DataFrame:
    """Upper-confidence allocation per bundle_id with one state for all its workers (the twin of control.allocation_trace).

    observations: bundle_id long, round_index long, worker string, time timestamp, objective_improvement
    and structural_collapse_rate double, failed boolean. A round is rewarded when all ``workers`` have
    reported, or when the watermark has passed its last report by ``wait``; rounds close in order, so
    later ones wait. A report for a closed round comes out without an arm and changes nothing; Spark leaves
    out what comes when the watermark (``late`` behind) has passed it.
    """
    wait_ms = int(wait.total_seconds() * 1000)
    timed = _timed(observations, "time", late).withColumn("_ms", F.unix_millis("time"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, weights, used, waiting = state.get if state.exists else (-1, priorities, [0] * len(priorities), "[]")
        arms, waiting, out = Arms(list(weights), [int(n) for n in used]), json.loads(waiting), []
        for part in [] if state.hasTimedOut else parts:
            for x in part[OBSERVED].astype(object).where(part[OBSERVED].notna(), None).itertuples(index=False):
                row = [int(x[0]), x[1], int(x[2]), None if x[3] is None else float(x[3]), float(x[4] or 0.0), bool(x[5])]
                if row[0] <= last:
                    out.append((key[0], row[0], row[1], None, None))
                else:
                    waiting.append(row)
        mark = state.getCurrentWatermarkMs()
        for now in sorted({r[0] for r in waiting}):
            these = [r for r in waiting if r[0] == now]
            if len({r[1] for r in these}) < workers and max(r[2] for r in these) + wait_ms > mark:
                break
            frame = pd.DataFrame(sorted(these, key=lambda r: (r[1], r[2])), columns=OBSERVED)
            out += [(key[0], at, name, arm, weight) for at, name, arm, weight in allocate(frame, arms, "round_index", "worker")]
            waiting, last = [r for r in waiting if r[0] != now], now
        state.update((int(last), arms.weights, arms.used, json.dumps(waiting)))
        if waiting:
            first = min(r[0] for r in waiting)
            state.setTimeoutTimestamp(max(max(r[2] for r in waiting if r[0] == first) + wait_ms, mark + 1))
        yield pd.DataFrame(out, columns=["bundle_id", "round_index", "worker", "arm", "weight"]).astype({"arm": "Int32", "weight": "float64"})

    return timed.groupBy("bundle_id").applyInPandasWithState(fold, "bundle_id long, round_index long, worker string, arm int, weight double", "last long, weights array<double>, used array<long>, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
