"""Incremental ingest of landing files and of stored captures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rxframe import constants as K
from rxframe import schemas
from rxframe.plans.pipeline import refine
from rxframe.session import passing
from rxframe.sinks.layers import Layers
from rxframe.sources import landing


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    run_id: str,
    extensions: list[str] | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append lineage rows for files not seen before, then stop.

    Spark's stream skips names that begin with a dot or an underscore. They are listed at each start into a table in the
    checkpoint, which is a second source of the same stream. A checkpoint of the form with one source cannot go on.
    """
    accepted = extensions or list(K.IMAGE_TYPES)
    files = (
        spark.readStream.format("binaryFile")
        .schema(landing.FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .filter(landing.extension(F.col("path")).isin(accepted))
    )
    listed = f"{checkpoint.rstrip('/')}/hidden"
    landing.list_hidden(spark, folder, listed, accepted, files_per_batch)
    hidden = spark.readStream.schema(landing.LISTED).option("maxFilesPerTrigger", 1).parquet(listed)
    return (
        landing.lineage(files.unionByName(landing.read_listed(hidden)), run_id)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refine_new_captures(
    spark: SparkSession,
    layers: Layers,
    products: DataFrame,
    checkpoint: str,
    scorer: str = "weighted",
    at: Column | None = None,
    files_per_batch: int = 1000,
    after: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Bring captures appended since the last call into lines and matches, then stop.

    Upserts are keyed, and rejections are appended under the name of the stream and the number of the micro-batch, so one
    that is run again, whole or from any step, leaves what a single run leaves.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        with passing() as keep:
            refine(rows, products, layers, scorer, at, batch=f"stream-{stream}-{number:09d}", keep=keep)
        if after:
            after(number)

    return (
        spark.readStream.schema(schemas.BRONZE)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(layers.bronze)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
