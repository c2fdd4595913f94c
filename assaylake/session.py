"""Session helpers: a local session for tests and benches, package shipping, shared scratch tables."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_scopes = threading.local()


def local_session(cpus: int | str = 8, memory: str = "12g", app: str = "assaylake") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per context)."""
    context = spark.sparkContext
    if getattr(context, "_assaylake_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="assaylake-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(PACKAGE.rglob("*.py")):
            packed.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._assaylake_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_assaylake_scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="spark-assaylake-", dir=os.environ.get("TMPDIR", "/tmp"))
            spark.sparkContext._assaylake_scratch = root
    return root.rstrip("/")


def _written(spark: SparkSession) -> dict[str, str | None]:
    """Paths of the tables that materialize() wrote and nobody dropped, with the catalogue's name of a bucketed one."""
    context = spark.sparkContext
    if not hasattr(context, "_assaylake_tables"):
        context._assaylake_tables = {}
    return context._assaylake_tables


def materialize(df: DataFrame, name: str = "t", buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write a frame as a Parquet table in the shared folder and read it back; cuts lineage, survives lost executors.

    With buckets (how many, by which column) the table is bucketed: grouping by that column then needs no
    exchange. The shuffles of the write are of no use afterwards: a collection of the driver's garbage lets
    Spark's cleaner delete their files now rather than at some later time.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/assaylake/{name}-{uuid.uuid4().hex}"
    writer, table = df.write.option("compression", "zstd"), None
    if buckets is None:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        table = f"assaylake_{uuid.uuid4().hex}"
        df.repartition(*buckets).write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(*buckets).saveAsTable(table)
        out = spark.table(table)
    _written(spark)[path] = table
    if _open_scopes():
        _open_scopes()[-1].frames.append(out)
    out._assaylake_path = path
    out.isEmpty()  # until a further job has run, the scheduler still refers to the write's plan
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def _drop(spark: SparkSession, path: str, table: str | None) -> None:
    if table is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in frames:
        path = df._assaylake_path
        if path in _written(df.sparkSession):
            _drop(df.sparkSession, path, _written(df.sparkSession).pop(path))


def _open_scopes() -> list[Scratch]:
    """The scopes that this thread is in, the innermost last."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


class Scratch:
    """A scope whose end deletes every table that materialize() wrote inside it (in this thread), but those kept.

    What the work returns may read kept tables alone. With another scope around it, that one has them next.
    """

    def __init__(self):
        self.frames: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __enter__(self) -> Scratch:
        _open_scopes().append(self)
        return self

    def __exit__(self, *problem) -> None:
        _open_scopes().pop()
        drop_materialized(*[f for f in self.frames if all(f is not k for k in self.kept)])
        if _open_scopes():
            _open_scopes()[-1].frames += self.kept
