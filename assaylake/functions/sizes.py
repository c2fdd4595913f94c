"""Bounds of tables that are sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows as a broadcast side, after a check that there are at most that many; more is an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a dictionary of more than {most} rows isn't broadcast")
    return F.broadcast(rows)


def few(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows as a broadcast side if there are at most that many, else as they are: a join by a few keys isn't a few tasks."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
