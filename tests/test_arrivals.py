"""Streams of arrivals against their batch twins, with restarts, expiry, timers and late rows."""

import random
from datetime import datetime, timedelta

import pytest

from assaylake.operators import control
from assaylake.streaming import arrivals

START = datetime(2024, 1, 1)


class Arriving:
    """Batches of rows that arrive one after the other; each run of the stream starts anew from its checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, spark.createDataFrame([], schema).schema, 0

    def run(self, rows, make):
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        query = make(stream).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/cp").outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return [tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()]


def test_novelty_stream_equals_batch(spark, tmp_path):
    """Three runs, the second and third from the checkpoint; pauses longer than an hour make a fingerprint new again."""
    rng = random.Random(9)
    schema = "id long, fingerprint string, ts timestamp"
    minutes = sorted(rng.randrange(600) for _ in range(120))
    rows = [(1000 - i if i % 10 == 0 else i, f"f{rng.randrange(9)}", START + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    history = spark.createDataFrame([("f1", 7), ("f1", 5), ("f2", 9), (None, 1), ("gone", 2)], "fingerprint string, history_id long")
    keep, source = timedelta(hours=1), Arriving(spark, tmp_path, schema)
    make = lambda s: arrivals.novelty_stream(s, history, "id", "fingerprint", "ts", keep)
    cuts = [0, 37, 38, 90, 120]
    for a, b in zip(cuts, cuts[1:]):
        # What has the time of the row before goes with it: order inside a batch is by time and id.
        while 0 < b < 120 and minutes[b] == minutes[b - 1]:
            b += 1
        got = source.run([r for r in rows[a:b] if r not in rows[:a]], make)
        rows_so_far = b
    seen = {r[0] for r in got}
    got = source.run([r for r in rows if r[0] not in seen], make) if len(seen) < len(rows) else got
    want = [tuple(r) for r in arrivals.arrival_novelty(spark.createDataFrame(rows, schema), history, "id", "fingerprint", "ts", keep).collect()]
    assert rows_so_far == 120 and sorted(got) == sorted(want)
    assert {s for *_, s in want} == {"history", "stream", "new"}


def test_novelty_without_fingerprints(spark):
    rows = spark.createDataFrame([(1, None, START), (2, None, START), (3, "x", START)], "id long, fingerprint string, ts timestamp")
    got = arrivals.arrival_novelty(rows, spark.createDataFrame([], "fingerprint string, history_id long"), "id", "fingerprint", "ts", timedelta(hours=1)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, None, "new"), (2, 2, None, "new"), (3, 3, None, "new")]


def test_session_stream_equals_batch(spark, tmp_path):
    """Rows shuffled within the watermark's delay; a last event far later closes all sessions."""
    rng = random.Random(1)
    schema = "ts timestamp, user long, kind string"
    rows = [(START + timedelta(minutes=rng.randrange(900)), rng.randrange(4), rng.choice(["view", "error"])) for _ in range(150)]
    rows.sort(key=lambda r: r[0] + timedelta(minutes=rng.randrange(60)))
    end = (START + timedelta(days=3), 99, "view")
    source = Arriving(spark, tmp_path, schema)
    make = lambda s: arrivals.session_counts(s, "ts", "user", "kind", late="2 hours")
    for part in (rows[:50], rows[50:100], rows[100:] + [end]):
        got = source.run(part, make)
    want = [tuple(r) for r in arrivals.session_counts(spark.createDataFrame(rows, schema), "ts", "user", "kind").collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_late_rows_are_shown(spark, tmp_path):
    schema = "ts timestamp, user long, kind string"
    at = lambda h: START + timedelta(hours=h)
    source = Arriving(spark, tmp_path, schema)
    make = lambda s: arrivals.late_rows(s, "ts", "2 hours")
    assert source.run([(at(1), 1, "a"), (at(10), 2, "b")], make) == []
    got = source.run([(at(7), 3, "late"), (at(9), 4, "in time"), (at(20), 5, "c")], make)
    assert [r[1:] for r in got] == [(3, "late")]
    assert sorted(r[1] for r in source.run([(at(9), 6, "late now")], make)) == [3, 6]


@pytest.mark.parametrize("cuts", [(0, 200), (0, 31, 90, 120, 200)])
def test_shared_allocation_stream_equals_batch(spark, tmp_path, cuts):
    """Three workers a round in shuffled order; a round that one worker never reports closes by the watermark."""
    rng = random.Random(6)
    schema = "bundle_id long, round_index long, worker string, time timestamp, objective_improvement double, structural_collapse_rate double, failed boolean"
    rows = []
    for b in (1, 2):
        for r in range(20):
            for w in ("x", "y", "z"):
                if (b, r, w) != (2, 12, "y"):
                    rows.append((b, r, w, START + timedelta(minutes=5 * r + rng.randrange(4)), None if rng.random() < 0.1 else rng.uniform(-2, 2), rng.random(), rng.random() < 0.3))
    rows.sort(key=lambda x: (x[3], rng.random()))
    source, first = Arriving(spark, tmp_path, schema), [0.9, 0.65, 0.6]
    make = lambda s: arrivals.shared_allocation_stream(s, first, 3)
    for a, b in zip(cuts, cuts[1:]):
        source.run(rows[a:b], make)
    after = [(3, 0, w, START + timedelta(days=1), 0.0, 0.0, False) for w in ("x", "y", "z")]
    got = source.run(after, make)
    want = control.allocation_trace(spark.createDataFrame(rows + after, schema), "bundle_id", first, worker="worker").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(want) == 122
    late = source.run([(3, 0, "x", START + timedelta(days=1, minutes=1), 1.0, 0.0, False)], make)
    assert (3, 0, "x", None, None) in late and len(late) == 123
