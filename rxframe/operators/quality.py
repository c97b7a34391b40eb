"""Expectations on prescription lines, quarantine and failure counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxframe import constants as K
from rxframe.functions import text
from rxframe.operators.captures import document


def first_failure() -> Column:
    """Reason of the first failed expectation, null for a clean line."""
    value, unit = F.col("dosage_value"), F.col("dosage_unit")
    return F.coalesce(
        F.nullif(F.col("rejection_reason"), F.lit("")),
        F.when(text.strip(F.col("drug_name_normalized")) == "", "empty_drug_name"),
        F.when(
            ~F.coalesce(F.col("extraction_confidence").between(0.0, 1.0), F.lit(False)),
            "confidence_out_of_range",
        ),
        F.when(~value.between(K.DOSE_MIN, K.DOSE_MAX), "dosage_out_of_range"),
        F.when(~F.lower(unit).isin(K.DOSE_UNITS), "unknown_dosage_unit"),
    )


def check(lines: DataFrame) -> DataFrame:
    return lines.withColumn("rejection_reason", first_failure())


def split(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean lines and quarantined lines."""
    checked = check(lines)
    return (
        checked.filter("rejection_reason IS NULL"),
        checked.filter("rejection_reason IS NOT NULL"),
    )


def failure_counts(checked: DataFrame, *by: str) -> DataFrame:
    """Rows per rejection reason."""
    return (
        checked.filter("rejection_reason IS NOT NULL")
        .groupBy(*by, "rejection_reason")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def failure_summary(checked: DataFrame) -> DataFrame:
    """One row: reason -> count map, with ``zero_rows`` when no clean line is left."""
    per_reason = checked.groupBy("rejection_reason").agg(
        F.count(F.lit(1)).cast("int").alias("failures")
    )
    entry = F.when(
        F.col("rejection_reason").isNotNull(), F.struct("rejection_reason", "failures")
    )
    clean = F.coalesce(F.sum(F.when(F.col("rejection_reason").isNull(), F.col("failures"))), F.lit(0))
    zero = F.when(clean == 0, F.create_map(F.lit("zero_rows"), F.lit(1))).otherwise(
        F.create_map().cast("map<string,int>")
    )
    return per_reason.agg(
        F.map_concat(F.map_from_entries(F.collect_list(entry)), zero).alias("validation_failures")
    )


def row_count_trend(metrics: DataFrame, runs: int = 7) -> DataFrame:
    """Silver rows of each run against the average of the runs before it."""
    before = Window.orderBy("run_finished_at", "pipeline_run_id").rowsBetween(-runs, -1)
    return metrics.select(
        "pipeline_run_id",
        "silver_rows",
        F.round(F.avg("silver_rows").over(before), 4).alias("trailing_average"),
    )


def given_names(requests: DataFrame, column: str = "name") -> DataFrame:
    """Trimmed names, blank ones left out."""
    return requests.withColumn(column, text.strip(F.col(column))).filter(F.col(column) != "")


def prescriptions_only(captures: DataFrame) -> DataFrame:
    """Captures whose document says it is a prescription."""
    doc = document(F.col("raw_response"))
    return captures.filter(F.try_variant_get(doc, "$[0].is_prescription", "boolean"))
