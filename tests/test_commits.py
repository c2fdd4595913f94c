"""Committed batches: replays, lost and racing writers, versions, indexes, reports and restarted streams."""

import hashlib
import os

import pytest

from assaylake.sources import commits

SCHEMA = "id long, v string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(spark, path, version=None):
    return sorted(map(tuple, commits.read(spark, path, SCHEMA, version).collect()))


def test_replays_and_versions(spark, tmp_path):
    path = str(tmp_path / "log")
    assert stored(spark, path) == [] and commits.commits(spark, path) == []
    assert commits.commit(frame(spark, (1, "a"), (1, "a")), path, "one") == 1
    assert commits.commit(frame(spark), path, "none") == 2
    assert commits.commit(frame(spark, (2, None)), path, "two") == 3
    assert commits.commit(frame(spark, (9, "replayed with other rows")), path, "one") == 1
    assert stored(spark, path, 1) == [(1, "a"), (1, "a")] and sorted(map(str, stored(spark, path))) == ["(1, 'a')", "(1, 'a')", "(2, None)"]
    assert [tuple(r) for r in commits.index_manifest(spark, path).collect()] == [("one", 1, 2), ("none", 2, 0), ("two", 3, 1)]


def test_a_writer_lost_before_its_commit(spark, tmp_path, monkeypatch):
    path, publish = str(tmp_path / "log"), commits._publish
    commits.commit(frame(spark, (1, "a")), path, "one")

    def lost(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "_publish", lost)
    with pytest.raises(KeyboardInterrupt):
        commits.commit(frame(spark, (2, "b")), path, "two")
    assert len(os.listdir(f"{path}/data")) == 2 and stored(spark, path) == [(1, "a")]
    monkeypatch.setattr(commits, "_publish", publish)
    assert commits.commit(frame(spark, (2, "b")), path, "two") == 2
    assert stored(spark, path) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("other", ["three", "two"])
def test_racing_writers(spark, tmp_path, monkeypatch, other):
    """Another writer takes the version between a writer's look and its commit: with another batch, or with the same."""
    path, publish = str(tmp_path / "log"), commits._publish
    commits.commit(frame(spark, (1, "a")), path, "one")

    def slow(spark, path, commit):
        monkeypatch.setattr(commits, "_publish", publish)
        commits.commit(frame(spark, (3, "c")), path, other)
        return publish(spark, path, commit)

    monkeypatch.setattr(commits, "_publish", slow)
    assert commits.commit(frame(spark, (2, "b")), path, "two") == (3 if other == "three" else 2)
    assert stored(spark, path) == ([(1, "a"), (2, "b"), (3, "c")] if other == "three" else [(1, "a"), (3, "c")])


def test_index_and_compaction(spark, tmp_path):
    path = str(tmp_path / "index")
    commits.commit(frame(spark, (1, "a"), (2, "a")), path, "b1")
    commits.commit(frame(spark, (1, "c"), (3, "a")), path, "b2")
    index = lambda v=None: sorted(map(tuple, commits.read_index(spark, path, SCHEMA, "id", "v", v).collect()))
    assert index(1) == [(1, "a"), (2, "a")] and index() == [(1, "c"), (2, "a"), (3, "a")]
    assert commits.compact_index(spark, path, SCHEMA, "id", "v") == 3 == commits.compact_index(spark, path, SCHEMA, "id", "v") - 1
    assert stored(spark, path) == index() == [(1, "c"), (2, "a"), (3, "a")] and index(1) == [(1, "a"), (2, "a")]


def test_reports_of_runs(spark, tmp_path):
    path = str(tmp_path / "report")
    for run, attempt, row in (("r1", "1", (1, "x")), ("r2", "1", (2, "y")), ("r1", "2", (1, "z")), ("r1", "1", (7, "late replay"))):
        inventory = commits.write_run(frame(spark, row), path, run, attempt).collect()
    assert stored(spark, path) == [(1, "z"), (2, "y")] and stored(spark, path, 2) == [(1, "x"), (2, "y")]
    raw = open(inventory[0].path.removeprefix("file:"), "rb").read()
    assert (inventory[0].byte_size, inventory[0].sha256) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_stream_that_runs_an_epoch_again(spark, tmp_path):
    """The stream's own note of its last epoch is lost: the epoch runs again and adds nothing."""
    path = str(tmp_path / "log")
    for rows in ([(1, "a")], [(2, "b"), (3, "c")]):
        frame(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(commits.append_stream(path, "s")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert stored(spark, path) == [(1, "a"), (2, "b"), (3, "c")]
    for name in os.listdir(tmp_path / "cp" / "commits"):
        if name.strip(".crc").endswith("1"):
            os.remove(tmp_path / "cp" / "commits" / name)
    run()
    assert stored(spark, path) == [(1, "a"), (2, "b"), (3, "c")] and len(commits.commits(spark, path)) == 2
