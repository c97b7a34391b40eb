"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build(app: str = "rxframe", master: str | None = None, **conf: str) -> SparkSession:
    # Call-site capture costs milliseconds per column expression and can only be set here.
    builder = SparkSession.builder.appName(app).config(
        "spark.python.sql.dataFrameDebugging.enabled", "false"
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import the scoring code; they need not share the driver's folder or have it installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="rxframe-"), "rxframe"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; deployment sizing stays with the cluster."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # JSON with a repeated key is still JSON; the last value counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Scoring rows carry whole name arrays, so batches must be bounded by bytes and by a low count.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a machine-local folder; on a cluster executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rxframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rxframe-{uuid.uuid4().hex}"


def lazy(df, name: str = "stage"):
    """``df`` as it is: what operators do with intermediate tables unless the caller wants them stored."""
    return df


def settle(df, name: str = "stage"):
    """Cut lineage by writing ``df`` to the shared scratch folder and reading it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when its write ends, not when the driver happens to collect garbage.

    For writes, whose plan nobody runs again.
    """
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def _pack(df, path: str):
    spark = df.sparkSession
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(df, name: str = "stage"):
    """``settle`` for large tables: written with zstd, and the shuffle files behind it go."""
    return _pack(df, f"{scratch_root(df.sparkSession)}/{name}")


@contextmanager
def passing() -> Iterator[Callable]:
    """A ``pack`` whose tables are removed at the end: what reads them has to be written by then."""
    made = []

    def keep(df, name: str = "stage"):
        made.append((df.sparkSession, scratch_root(df.sparkSession)))
        return _pack(df, f"{made[-1][1]}/{name}")

    try:
        yield keep
    finally:
        for spark, root in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(root)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
