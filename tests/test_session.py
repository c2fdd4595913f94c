"""Scratch tables: scopes that delete them, bucketed ones that spare an exchange."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaylake.session import Scratch, drop_materialized, materialize, scratch_root


def there(df):
    return Path(df._assaylake_path.removeprefix("file:").replace("//", "/", 1)).exists()


def test_scopes_drop_their_tables(spark):
    before = materialize(spark.range(3), "before")
    with Scratch() as outer:
        with Scratch() as inner:
            gone, kept = materialize(spark.range(5), "gone"), inner.keep(materialize(spark.range(7), "kept"))
            assert there(gone)
        assert not there(gone) and there(kept) and kept.count() == 7
        with pytest.raises(ValueError, match="stop"), Scratch():
            broken = materialize(spark.range(2), "broken")
            raise ValueError("stop")
        assert not there(broken)
        last = outer.keep(materialize(kept.where("id > 2"), "last"))
    assert not there(kept) and last.count() == 4 and there(before)
    drop_materialized(before, last)
    assert not there(before) and not there(last)
    drop_materialized(before)


def test_bucketed_tables_are_grouped_without_an_exchange(spark):
    table = materialize(spark.range(1000).withColumn("part", F.col("id") % 13), "bucketed", (4, "part"))
    sums = table.groupBy("part").agg(F.sum("id").alias("s"))
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert {r.part: r.s for r in sums.collect()} == {p: sum(range(p, 1000, 13)) for p in range(13)}
    drop_materialized(table)
    assert not there(table)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())
