"""The stored layers below one root folder: captures, lines, matches, metrics, serving."""

from __future__ import annotations

import uuid

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rxframe import schemas
from rxframe.session import passing, swept
from rxframe.sinks import upsert as U

#: Folder name of appended batches.
BATCH = "append_batch"
LINE_KEYS = ["source_file_hash", "line_id"]
#: Lines of one document are stored together.
NEAR = ["source_file_hash"]
LAYOUTS = {
    "silver": schemas.SILVER,
    "quarantine": schemas.SILVER,
    "gold": schemas.GOLD,
    "serving": schemas.GOLD,
    "metrics": schemas.METRICS,
}


def latest(*first: str, columns: list[str]) -> list[Column]:
    """Newest first; the other columns make the order total."""
    rest = [c for c in columns if c not in first]
    return [F.col(c).desc() for c in [*first, *rest]]


@dataclass(frozen=True)
class Layers:
    """Paths of every layer; ``root`` may be any Hadoop file system address."""

    root: str
    buckets: int = 64

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze/prescriptions"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver/prescription_lines"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine/prescription_lines"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold/matched_products"

    @property
    def metrics(self) -> str:
        return f"{self.root}/gold/pipeline_metrics"

    @property
    def serving(self) -> str:
        return f"{self.root}/serving/prescriptions"

    @property
    def serving_metrics(self) -> str:
        return f"{self.root}/serving/pipeline_metrics"

    # --- writes ---------------------------------------------------------------

    def append_bronze(self, captures: DataFrame, stored: bool = False) -> int:
        """Append captures by date and return how many; the rows are computed once.

        They are written before they are dealt out by date, unless they are ``stored``, so that the shuffles that make them and
        the one that deals out their texts are not on disk together.
        """
        seen = Observation("bronze")
        counted = captures.observe(seen, F.count(F.lit(1)).alias("rows"))
        with passing() as keep, swept(captures.sparkSession):
            rows = counted if stored else keep(counted, "captures")
            dealt = rows.hint("rebalance", "ingest_date").write.mode("append").option("compression", "zstd")
            dealt.partitionBy("ingest_date").parquet(self.bronze)
        return seen.get["rows"]

    def upsert_silver(self, clean: DataFrame, stored: bool = False) -> None:
        order = latest("processed_at", columns=clean.columns)
        U.upsert(clean, self.silver, LINE_KEYS, order, self.buckets, stored, NEAR)

    def _append(self, rows: DataFrame, path: str, batch: str | None) -> None:
        """Append under the name of a batch; writing a batch of that name again replaces its own rows only."""
        named = rows.withColumn(BATCH, F.lit(batch or uuid.uuid4().hex))
        with swept(rows.sparkSession):
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)

    def append_quarantine(self, rejected: DataFrame, batch: str | None = None) -> None:
        self._append(rejected, self.quarantine, batch)

    def upsert_gold(self, matched: DataFrame, stored: bool = False) -> None:
        order = latest("matched_at", columns=matched.columns)
        U.upsert(matched, self.gold, LINE_KEYS, order, self.buckets, stored, NEAR)

    def append_metrics(self, metrics: DataFrame, batch: str | None = None) -> None:
        self._append(metrics, self.metrics, batch)

    def publish(self, matched: DataFrame, stored: bool = False) -> None:
        """Insert or replace matched lines in the serving copy."""
        order = latest("matched_at", columns=matched.columns)
        U.upsert(matched, self.serving, LINE_KEYS, order, self.buckets, stored, NEAR)

    def mirror_metrics(self, metrics: DataFrame) -> None:
        """Replace the run's row in the serving copy, maps as JSON text."""
        flat = flat_metrics(metrics)
        order = [F.col("run_finished_at").desc()]
        U.upsert(flat, self.serving_metrics, ["pipeline_run_id"], order, 1)

    # --- reads ----------------------------------------------------------------

    def read_bronze(
        self,
        spark: SparkSession,
        run_id: str | None = None,
        first_date: str | None = None,
        last_date: str | None = None,
    ) -> DataFrame:
        """Captures of a run and/or a date range; the range prunes folders."""
        if not U.exists(spark, self.bronze):
            return spark.createDataFrame([], schemas.BRONZE)
        rows = spark.read.schema(schemas.BRONZE).parquet(self.bronze)
        if first_date:
            rows = rows.filter(F.col("ingest_date") >= F.lit(first_date).cast("date"))
        if last_date:
            rows = rows.filter(F.col("ingest_date") <= F.lit(last_date).cast("date"))
        return rows.filter(F.col("pipeline_run_id") == run_id) if run_id else rows

    def read(self, spark: SparkSession, layer: str, run_id: str | None = None) -> DataFrame:
        rows = U.read_table(spark, getattr(self, layer), LAYOUTS.get(layer)).drop(BATCH)
        return rows.filter(F.col("pipeline_run_id") == run_id) if run_id else rows

    def register(self, spark: SparkSession, database: str = "default") -> None:
        """Make every written layer readable by name: appended layers as external tables, upserted ones as views.

        A view shows the version at the time of the call, so call again after an upsert.
        """
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name in ("bronze", "silver", "quarantine", "gold", "metrics", "serving"):
            path = getattr(self, name)
            if U.exists(spark, path):
                folders = U.folders(spark, path)
                if folders:
                    parts = " UNION ALL ".join(f"SELECT * FROM parquet.`{p}`" for p in folders)
                    spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {parts}")
                    continue
                spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {database}.{name} USING parquet LOCATION '{path}'"
                )
                if name in ("bronze", "quarantine", "metrics"):
                    spark.sql(f"MSCK REPAIR TABLE {database}.{name}")


def flat_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {
            "stage_durations_sec": F.to_json("stage_durations_sec"),
            "validation_failures": F.to_json("validation_failures"),
        }
    )
