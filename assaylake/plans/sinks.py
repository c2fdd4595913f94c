"""Committed batches over events, documents and orders: a log with a replay, an index of bundles, reports of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assaylake.plans.registry import query
from assaylake.session import materialize, scratch_root
from assaylake.sources import commits


def place(t, name: str) -> str:
    return f"{scratch_root(t.spark)}/assaylake/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, value FROM {events}")
def audit_log(t):
    """The events appended by quarters of their ids, one quarter twice, and read back."""
    path, rows = place(t, "log"), t.events.select("event_id", "user_id", "event_type", "value")
    for part in (0, 1, 2, 1, 3):
        commits.commit(rows.where(F.col("event_id") % 4 == part), path, f"part-{part}")
    return commits.read(t.spark, path, rows.schema)


@query("""SELECT o_custkey AS record_id, max(o_orderkey) AS newest, arg_max(o_totalprice, o_orderkey) AS value FROM {orders} GROUP BY 1""")
def index_upsert(t):
    """Bundles of orders, a status each, upserted into an index of customers, compacted, and the last bundle after that."""
    path = place(t, "index")
    rows = t.orders.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("newest"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    bundle = lambda status: commits.latest_by_key(rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), "record_id", "newest")
    schema = rows.drop("o_orderstatus").schema
    for status in ("F", "O"):
        commits.commit(bundle(status), path, status)
    commits.compact_index(t.spark, path, schema, "record_id", "newest")
    commits.commit(bundle("P"), path, "P")
    return commits.read_index(t.spark, path, schema, "record_id", "newest")


@query("""SELECT o_orderpriority AS run_id, o_orderstatus, count(*) AS n, CAST(sum(floor(o_totalprice + 0.5)) AS BIGINT) AS total FROM {orders} GROUP BY 1, 2""")
def run_reports(t):
    """A report a priority, the first of them written twice with other rows at first; what readers see in the end."""
    path = place(t, "report")
    total = F.sum(F.floor(F.col("o_totalprice") + 0.5)).cast("long").alias("total")
    rows = materialize(t.orders.groupBy(F.col("o_orderpriority").alias("run_id"), "o_orderstatus").agg(F.count("*").alias("n"), total), "reports")
    runs = [f"{i}-{n}" for i, n in enumerate(("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"), 1)]  # the priorities there are
    commits.write_run(rows.limit(1), path, runs[0], "first")
    for run in runs:
        commits.write_run(rows.where(F.col("run_id") == run), path, run, "last")
    return commits.read(t.spark, path, rows.schema)
