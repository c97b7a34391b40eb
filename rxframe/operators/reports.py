"""Run metrics, baskets, history, feedback and health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxframe import constants as K
from rxframe.functions import money
from rxframe.sinks.upsert import last_wins

RESULT = """struct<medicines:array<struct<brand:string,query:string>>,
 totals:struct<saving:double>, interactions:array<struct<severity:string>>>"""


def _rate(part, whole):
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


# --- pipeline -----------------------------------------------------------------


def match_stats(matched: DataFrame, *by: str) -> DataFrame:
    hits = F.count(F.when(F.col("match_method") != "unmatched", 1))
    total = F.count(F.lit(1))
    grouped = matched.groupBy(*by) if by else matched
    return grouped.agg(
        total.alias("gold_rows"), hits.alias("matched_rows"), _rate(hits, total).alias("match_rate")
    )


def mean_confidence(lines: DataFrame, *by: str) -> DataFrame:
    confidence = F.col("extraction_confidence").cast("decimal(9,6)")
    mean = F.try_divide(F.sum(confidence).cast("double"), F.count("extraction_confidence"))
    grouped = lines.groupBy(*by) if by else lines
    return grouped.agg(
        F.count(F.lit(1)).alias("silver_rows"),
        F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("mean_confidence"),
    )


def run_metrics(
    runs: DataFrame,
    bronze: DataFrame,
    clean: DataFrame,
    failures: DataFrame,
    matched: DataFrame,
) -> DataFrame:
    """One row per run of runs(pipeline_run_id, run_started_at, run_finished_at,
    stage_durations_sec, status), with the counts found in the layers.

    ``failures`` has (pipeline_run_id, rejection_reason, failures) counted before the split.
    """
    key = "pipeline_run_id"
    per_reason = failures.groupBy(key).agg(
        F.sum("failures").alias("quarantine_rows"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct("rejection_reason", F.col("failures").cast("int")))
            )
        ).alias("validation_failures"),
    )
    joined = (
        runs.join(bronze.groupBy(key).agg(F.count(F.lit(1)).alias("bronze_rows")), key, "left")
        .join(mean_confidence(clean, key), key, "left")
        .join(per_reason, key, "left")
        .join(match_stats(matched, key), key, "left")
    )

    def number(c: str):
        return F.coalesce(c, F.lit(0)).cast("int").alias(c)

    reasons = F.coalesce("validation_failures", F.create_map().cast("map<string,int>"))
    zero = F.create_map(F.lit("zero_rows"), F.lit(1))
    return joined.select(
        key,
        "run_started_at",
        "run_finished_at",
        number("bronze_rows"),
        number("silver_rows"),
        number("quarantine_rows"),
        number("gold_rows"),
        number("matched_rows"),
        F.coalesce("match_rate", F.lit(0.0)).alias("match_rate"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
        "stage_durations_sec",
        "status",
        F.when(F.coalesce("silver_rows", F.lit(0)) == 0, F.map_concat(reasons, zero))
        .otherwise(reasons)
        .alias("validation_failures"),
    )


def latest_run(metrics: DataFrame) -> DataFrame:
    newest = F.max_by(
        F.struct(*metrics.columns), F.struct("run_finished_at", "pipeline_run_id")
    )
    return metrics.agg(newest.alias("run"), F.count(F.lit(1)).alias("total_runs"))


def pipeline_health(metrics: DataFrame, served: DataFrame) -> DataFrame:
    """One row on the newest run; status ``no_runs`` when there is none."""
    served_rows = served.agg(F.count(F.lit(1)).alias("served"))
    rows = latest_run(metrics).withColumn("served", F.lit(None).cast("long")).unionByName(
        served_rows, allowMissingColumns=True
    )
    one = rows.agg(
        F.max_by("run", F.col("total_runs")).alias("run"),
        F.max("total_runs").alias("total_runs"),
        F.max("served").alias("served"),
    )
    silver = F.coalesce("run.silver_rows", F.lit(0))
    quarantine = F.coalesce("run.quarantine_rows", F.lit(0))
    none = F.col("total_runs") == 0
    status = F.when(none, "no_runs").when(F.col("run.status") == "success", "ok")
    return one.select(
        status.otherwise(F.col("run.status")).alias("status"),
        F.when(none, F.lit(K.NO_RUNS_DETAIL)).alias("detail"),
        F.col("run.pipeline_run_id").alias("last_run_id"),
        F.col("run.run_finished_at").alias("last_run_at"),
        "total_runs",
        F.col("run.match_rate").alias("match_rate"),
        F.col("run.mean_confidence").alias("mean_confidence"),
        F.col("run.bronze_rows").alias("bronze_rows"),
        F.when(~none, silver).alias("silver_rows"),
        F.when(~none, quarantine).alias("quarantine_rows"),
        F.col("run.gold_rows").alias("gold_rows"),
        F.col("run.matched_rows").alias("matched_rows"),
        F.when(~none, _rate(quarantine, silver + quarantine)).alias("quarantine_rate"),
        F.col("run.validation_failures").alias("validation_failures"),
        F.col("run.stage_durations_sec").alias("stage_durations_sec"),
        F.col("served").alias("served_prescription_lines"),
    )


def reconcile(**layers: DataFrame) -> DataFrame:
    """Rows per run in every given layer."""
    stacked = None
    for name, rows in layers.items():
        counted = rows.groupBy("pipeline_run_id").agg(F.count(F.lit(1)).alias(f"{name}_rows"))
        stacked = (
            counted
            if stacked is None
            else stacked.unionByName(counted, allowMissingColumns=True)
        )
    return stacked.groupBy("pipeline_run_id").agg(
        *[F.coalesce(F.max(f"{n}_rows"), F.lit(0)).alias(f"{n}_rows") for n in layers]
    )


# --- baskets ------------------------------------------------------------------


def basket_totals(lines: DataFrame, key: str = "rx_id") -> DataFrame:
    """Brand and generic cost per prescription over its matched lines."""
    matched = F.col("brand_price").isNotNull()
    sums = lines.groupBy(key).agg(
        F.coalesce(money.exact_sum(F.when(matched, F.col("brand_price"))), F.lit(0.0)).alias("brand"),
        F.coalesce(money.exact_sum(F.when(matched, F.col("generic_price"))), F.lit(0.0)).alias(
            "generic"
        ),
    )
    saving = F.col("brand") - F.col("generic")
    return sums.select(
        key,
        "brand",
        "generic",
        F.round(saving, 2).alias("saving"),
        money.percent(saving, F.col("brand")).alias("saving_pct"),
    )


# --- feedback -----------------------------------------------------------------


def feedback_stats(feedback: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    correct = F.count(F.when(F.col("verdict") == "correct", 1))
    return feedback.agg(
        total.alias("total"),
        correct.alias("correct"),
        F.count(F.when(F.col("verdict") == "wrong", 1)).alias("wrong"),
        F.rint(F.try_divide(correct, total) * 100).cast("int").alias("accuracy_pct"),
    )


def most_corrected(feedback: DataFrame, limit: int = K.MOST_CORRECTED_LIMIT) -> DataFrame:
    return (
        feedback.filter("verdict = 'wrong'")
        .groupBy(F.col("matched_brand").alias("brand"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "brand")
        .limit(limit)
    )


# --- history ------------------------------------------------------------------


def lifetime_saving(scans: DataFrame) -> DataFrame:
    saving = F.get_json_object("result", "$.totals.saving").try_cast("decimal(18,2)")
    total = F.coalesce(F.sum(saving), F.lit(0)).cast("double")
    return scans.groupBy("user_id").agg(F.round(total, 2).alias("total_saving"))


def scan_history(scans: DataFrame, limit: int = K.HISTORY_LIMIT) -> DataFrame:
    """Newest scans per user with medicine names, saving and number of warnings."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("id").desc()))
    result = F.from_json("result", RESULT)
    kept = scans.withColumn("_rank", newest).filter(F.col("_rank") <= limit).drop("_rank")
    return kept.withColumn("r", result).select(
        "id",
        "user_id",
        "source",
        "created_at",
        F.coalesce(
            F.transform(
                "r.medicines",
                lambda m: F.coalesce(F.nullif(m["brand"], F.lit("")), m["query"]),
            ),
            F.array().cast("array<string>"),
        ).alias("medicines"),
        F.coalesce("r.totals.saving", F.lit(0.0)).alias("saving"),
        F.coalesce(F.size("r.interactions"), F.lit(0)).alias("warnings"),
    )


def saved_medicines(user_meds: DataFrame) -> DataFrame:
    """First saved row per (user, brand); sort by (user_id, brand)."""
    return last_wins(user_meds, ["user_id", "brand"], [F.col("id")])
