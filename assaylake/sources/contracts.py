"""Typed scans with reject reasons, verified payloads, immutable upserts and caches by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assaylake.functions.scalars import reasons


def unknown_keys(json_col: str, known: list[str]) -> Column:
    """Whether a JSON text has keys besides the known ones."""
    return F.size(F.array_except(F.json_object_keys(json_col), F.array(*map(F.lit, known)))) > 0


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with reasons (the broken rules) and status valid or rejected."""
    return rows.withColumn("reasons", reasons(**rules)).withColumn("status", F.when(F.size("reasons") == 0, "valid").otherwise("rejected"))


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed JSON lines: rows with unknown fields, wrong types or non-finite numbers have a reject reason."""
    raw = spark.read.text(path)
    typed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}).alias("row"))
    wrong = [F.get_json_object("value", f"$.{f.name}").isNotNull() & F.col(f"row.{f.name}").isNull() for f in schema.fields]
    broken = wrong[0]
    for w in wrong[1:]:
        broken = broken | w
    rules = {"not_an_object": F.json_object_keys("value").isNull(), "unknown_field": unknown_keys("value", schema.names), "wrong_type": broken}
    return split_valid(typed, rules).select("row.*", "value", "status", "reasons")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, byte_size and SHA-256 of raw files; also the inventory of a sink's output."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def verify_payload(rows: DataFrame, payload: str, digest: str, size: str) -> DataFrame:
    """rows with status verified, digest_mismatch or size_mismatch; a missing part is a mismatch."""
    same = F.coalesce(F.sha2(payload, 256) == F.col(digest), F.lit(False))
    return rows.withColumn("status", F.when(~same, "digest_mismatch").when(~F.coalesce(F.octet_length(payload) == F.col(size), F.lit(False)), "size_mismatch").otherwise("verified"))


def immutable_upsert(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """key and outcome of each incoming key: insert, unchanged or conflict (also inside the batch)."""
    batch = incoming.groupBy(key).agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    known = existing.select(key, F.col(digest).alias("_old")).distinct()
    both = batch.join(known, key, "left")
    outcome = F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col("_lo"), "unchanged").otherwise("conflict")
    return both.select(key, outcome.alias("outcome"))


def cache_split(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): only misses go on to be computed."""
    return requests.join(cache, key), requests.join(cache, key, "left_anti")


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest order value, as an index upsert keeps it."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def upsert_index(index: DataFrame, bundle: DataFrame, key: str, order: str) -> DataFrame:
    """Index after a bundle: union, then the newest row of each key."""
    return latest_by_key(index.unionByName(bundle, allowMissingColumns=True), key, order)


def write_report_csv(rows: DataFrame, path: str) -> None:
    """Flat report: arrays joined by ';', nulls empty."""
    flat = [F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Append-only audit log."""
    rows.write.mode("append").parquet(path)


def latest_plan(rows: DataFrame, keys: list[str], plan: str) -> DataFrame:
    """Rows of the latest plan of each key; all rows of a key that has none."""
    last = rows.groupBy(*keys).agg(F.max(plan).alias("_last"))
    return rows.join(last, keys).where(F.col("_last").isNull() | (F.col(plan) == F.col("_last"))).drop("_last")


def structured_evidence(rows: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid evidence rows, and per source the numbers of valid and invalid ones.

    rows: source, record_type, keys (the fields that are filled); contracts (a dictionary): source,
    allowed_types, required. A source without a contract has no valid row; invalid rows are counted, not kept.
    """
    from assaylake.functions.sizes import dictionary

    of = contracts.select("source", F.col("allowed_types").alias("_types"), F.col("required").alias("_required"))
    ok = F.array_contains("_types", F.col("record_type")) & (F.size(F.array_except("_required", "keys")) == 0)
    judged = rows.join(dictionary(of), "source", "left").withColumn("_ok", F.coalesce(ok, F.lit(False))).drop("_types", "_required")
    counts = judged.groupBy("source").agg(F.count_if("_ok").alias("n_valid"), F.count_if(~F.col("_ok")).alias("n_invalid"))
    return judged.where("_ok").drop("_ok"), counts


def index_manifest(**tables: DataFrame) -> DataFrame:
    """Number of rows of each table of an index."""
    counts = [rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, rows in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def write_report(rows: DataFrame, path: str, run: str = "run_id") -> DataFrame:
    """Write a report as JSON, a folder a run, and return the inventory of its files: path, n_bytes, sha256.

    Runs that the report doesn't have stay as they are; a run that it has is replaced.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).json(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
