"""Landing files: listing, content hash and lineage columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe import constants as K

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LISTED = "path string, at long, length long"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _pattern(extensions: list[str]) -> str:
    """A glob for the extensions in any case."""
    names = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(names) + "}"


def _hidden(spark: SparkSession, folder: str, pattern: str) -> list[tuple]:
    """Paths, times and lengths of files that Spark's readers skip by name; contents are read in tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/[._]{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [(f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in found if f.isFile()]


def _contents(batches):
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        data = []
        for uri in batch.column("path").to_pylist():
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(path) as stream:
                data.append(stream.read())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "content"])


def read_listed(rows: DataFrame) -> DataFrame:
    """Files of a listing (``LISTED``) with their contents."""
    rows = rows.select("path", F.timestamp_millis("at").alias("modificationTime"), "length")
    return rows.mapInArrow(_contents, FILE_SCHEMA)


def list_hidden(spark: SparkSession, folder: str, listed: str, extensions: list[str], rows_per_file: int) -> None:
    """Append the hidden files of a folder that ``listed`` does not name yet to it; it is there afterwards."""
    found = spark.createDataFrame(_hidden(spark, folder, _pattern(extensions)), LISTED)
    if _exists(spark, listed):
        found = found.join(spark.read.schema(LISTED).parquet(listed), "path", "left_anti")
    found.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(listed)


def scan(
    spark: SparkSession, folder: str, extensions: list[str] | None = None
) -> DataFrame:
    """Files of a folder with an accepted extension in any case; a missing folder is empty.

    The extension is a filter on the listing, so other files are not opened. Names that begin with a dot or an
    underscore are files like others.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], FILE_SCHEMA)
    pattern = _pattern(extensions or list(K.IMAGE_TYPES))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    hidden = _hidden(spark, folder, pattern)
    if not hidden:
        return files
    return files.unionByName(read_listed(spark.createDataFrame(hidden, LISTED)))


def lineage(files: DataFrame, run_id: str, ingested_at: Column | None = None) -> DataFrame:
    """Content hash as identity, media type, size and run columns. Needs path and content."""
    types = F.create_map(*[F.lit(x) for pair in K.IMAGE_TYPES.items() for x in pair])
    at = (F.current_timestamp() if ingested_at is None else ingested_at).cast("timestamp")
    return files.select(
        F.lit(run_id).alias("pipeline_run_id"),
        F.sha2("content", 256).alias("source_file_hash"),
        F.col("path").alias("source_path"),
        F.coalesce(
            F.try_element_at(types, extension(F.col("path"))), F.lit(K.DEFAULT_MEDIA_TYPE)
        ).alias("media_type"),
        F.length("content").cast("long").alias("size_bytes"),
        at.alias("ingested_at"),
        F.to_date(at).alias("ingest_date"),
    )
