"""Tables of committed batches, for logs, indexes and reports that several writers or a restarted stream append to.

Rows of a batch are written to a folder of their own; then a small file that names the folder is put in
place under the next version's name, which fails where another writer was first. Readers take the
folders of such files alone. So a writer that is lost before that leaves nothing that anyone reads, a
batch that is replayed is known by its name and adds nothing, and a reader sees whole versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.sources.contracts import file_digests, latest_by_key

EVERYTHING = "*"


def _hadoop(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a table in order: version, batch, folder, format, replaces and n_rows; one small file a batch."""
    _, fs, conf = _hadoop(spark)
    where = fs.Path(f"{path}/commits")
    if not where.getFileSystem(conf).exists(where):
        return []
    texts = spark.read.text(f"{path}/commits", wholetext=True, pathGlobFilter="*.json").collect()
    return sorted((json.loads(t.value) for t in texts), key=lambda c: c["version"])


def _publish(spark: SparkSession, path: str, commit: dict) -> bool:
    """Put a commit's file in place as a whole; False if its version is taken."""
    jvm, fs, conf = _hadoop(spark)
    draft, final = fs.Path(f"{path}/drafts/{uuid.uuid4().hex}"), fs.Path(f"{path}/commits/{commit['version']:012d}.json")
    store = final.getFileSystem(conf)
    store.mkdirs(final.getParent())
    out = store.create(draft)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE  # a file that is there stays
    try:
        fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(draft), store.makeQualified(final), options)
    except Exception as problem:  # noqa: BLE001
        store.delete(draft, False)
        if "FileAlreadyExistsException" in str(problem):
            return False
        raise
    return True


def commit(rows: DataFrame, path: str, batch: str, replaces: str | None = None, kind: str = "parquet") -> int:
    """Append a batch and return its version; a batch that is known adds nothing.

    replaces is a name that several batches may share: readers take the last batch of a name alone.
    With EVERYTHING the batch stands for all before it. Two writers of one new batch may both write its
    rows; the first that commits counts.
    """
    spark = rows.sparkSession
    known = {c["batch"]: c["version"] for c in commits(spark, path)}
    if batch in known:
        return known[batch]
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.format(kind).save(f"{path}/{folder}")
    n_rows = spark.read.schema(rows.schema).format(kind).load(f"{path}/{folder}").count()
    while batch not in known:
        version = max(known.values(), default=0) + 1
        if _publish(spark, path, {"version": version, "batch": batch, "folder": folder, "format": kind, "replaces": replaces, "n_rows": n_rows}):
            return version
        known = {c["batch"]: c["version"] for c in commits(spark, path)}
    return known[batch]


def live(spark: SparkSession, path: str, version: int | None = None) -> list[dict]:
    """The commits whose rows a version (the last one) consists of."""
    found: list[dict] = []
    for c in commits(spark, path):
        if version is None or c["version"] <= version:
            gone = c["replaces"]
            found = [] if gone == EVERYTHING else [f for f in found if gone is None or f["replaces"] != gone]
            found.append(c)
    return found


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version; a table without commits is empty."""
    out = spark.createDataFrame([], schema)
    for kind in sorted({c["format"] for c in live(spark, path, version)}):
        folders = [f"{path}/{c['folder']}" for c in live(spark, path, version) if c["format"] == kind]
        out = out.unionByName(spark.read.schema(schema).format(kind).load(folders))
    return out


def append_stream(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of an append-only log: an epoch that is run again adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        commit(batch, path, f"{stream}-{epoch}")

    return write


def read_index(spark: SparkSession, path: str, schema, key: str, order: str, version: int | None = None) -> DataFrame:
    """An index as of a version: the newest row of each key by order over all its bundles."""
    return latest_by_key(read(spark, path, schema, version), key, order)


def compact_index(spark: SparkSession, path: str, schema, key: str, order: str) -> int:
    """Commit the newest rows as one batch that stands for all before it; earlier versions stay readable."""
    last = max((c["version"] for c in commits(spark, path)), default=0)
    return commit(read_index(spark, path, schema, key, order, last), path, f"compact-{last}", EVERYTHING)


def write_run(rows: DataFrame, path: str, run: str, attempt: str) -> DataFrame:
    """Commit a run's report as JSON in the place of its earlier attempts; the inventory of its files: path, byte_size, sha256."""
    spark = rows.sparkSession
    version = commit(rows, path, f"{run}:{attempt}", run, "json")
    folder = next(c["folder"] for c in commits(spark, path) if c["version"] == version)
    return file_digests(spark, f"{path}/{folder}/*.json")


def index_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """batch, version and n_rows of what a version consists of."""
    rows = [(c["batch"], c["version"], c["n_rows"]) for c in live(spark, path, version)]
    return spark.createDataFrame(rows, "batch string, version long, n_rows long").orderBy(F.col("version"))
