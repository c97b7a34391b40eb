"""Batch pipeline: captures to lines, matches, serving copy and metrics; replay and backfill."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe import schemas
from rxframe.operators import matching, quality, reports
from rxframe.operators.captures import parse_captures
from rxframe.session import pack, passing
from rxframe.sinks.layers import Layers
from rxframe.sinks.upsert import last_wins
from rxframe.sources.catalogue import signature_groups


def new_run_id() -> str:
    return f"run_{datetime.now(timezone.utc):%Y%m%dT%H%M%S}_{uuid.uuid4().hex[:8]}"


def clean_run_id(run_id: str) -> str:
    """A scheduler's run id without the characters paths dislike."""
    return re.sub(r"[:+.]", "", run_id)


def refine(
    bronze: DataFrame,
    products: DataFrame,
    layers: Layers,
    scorer: str = "weighted",
    at: Column | None = None,
    durations: dict | None = None,
    batch: str | None = None,
    keep: Callable = pack,
) -> tuple[DataFrame, DataFrame]:
    """Bronze rows into silver, quarantine and gold; returns (checked lines, matched lines).

    Only clean lines are matched. Running it again on the same rows changes nothing but the
    quarantine, which keeps every rejection (see ``quarantine_view``). A ``batch`` that is run again
    replaces its own rejections too, so then nothing changes at all. ``keep`` stores the returned lines: that of
    ``session.passing`` drops them where the layers are all that is wanted.
    """
    durations = {} if durations is None else durations

    def timed(name: str, work):
        start = time.monotonic()
        out = work()
        durations[name] = round(time.monotonic() - start, 2)
        return out

    checked = timed(
        "normalize", lambda: keep(quality.check(parse_captures(bronze, at)), "checked")
    )
    clean = checked.filter("rejection_reason IS NULL")

    def silver():
        layers.upsert_silver(clean, stored=True)
        layers.append_quarantine(checked.filter("rejection_reason IS NOT NULL"), batch)

    def match():
        with passing() as brief:
            found = matching.match_lines(clean, products, signature_groups(products), scorer, matched_at=at, keep=brief)
            return keep(found, "matched")

    timed("silver", silver)
    matched = timed("match", match)
    timed("gold", lambda: layers.upsert_gold(matched, stored=True))
    return checked, matched


def _batch(run_id: str, started: datetime) -> str:
    return f"{run_id}-{started:%Y%m%dT%H%M%S%f}"


def _metrics_row(spark, run_id, started, durations, status):
    return spark.createDataFrame(
        [(run_id, started, datetime.now(timezone.utc), durations, status)],
        "pipeline_run_id string, run_started_at timestamp, run_finished_at timestamp, "
        "stage_durations_sec map<string,double>, status string",
    )


def run(
    spark: SparkSession,
    captures: DataFrame,
    products: DataFrame,
    layers: Layers,
    run_id: str | None = None,
    scorer: str = "weighted",
) -> DataFrame:
    """One whole run over new captures; returns its metrics row.

    A run that breaks off leaves a metrics row whose status names the stage it reached.
    """
    run_id = clean_run_id(run_id) if run_id else new_run_id()
    started = datetime.now(timezone.utc)
    durations: dict[str, float] = {}
    try:
        return _run(spark, captures, products, layers, run_id, scorer, started, durations)
    except Exception:
        stages = ["bronze", "normalize", "silver", "match", "gold", "load", "metrics"]
        status = f"{next(s for s in stages if s not in durations)}_failed"
        empty = spark.createDataFrame([], schemas.METRICS)
        broken = empty.unionByName(
            _metrics_row(spark, run_id, started, durations, status), allowMissingColumns=True
        )
        layers.append_metrics(broken, _batch(run_id, started))
        layers.mirror_metrics(broken)
        raise


def _run(spark, captures, products, layers, run_id, scorer, started, durations) -> DataFrame:
    begin = time.monotonic()
    with passing() as keep:
        bronze = keep(captures.withColumn("pipeline_run_id", F.lit(run_id)), "captures")
        layers.append_bronze(bronze, stored=True)
        durations["bronze"] = round(time.monotonic() - begin, 2)
        checked, matched = refine(
            bronze, products, layers, scorer, durations=durations, batch=_batch(run_id, started), keep=keep
        )
        begin = time.monotonic()
        layers.publish(matched, stored=True)
        durations["load"] = round(time.monotonic() - begin, 2)
        runs = _metrics_row(spark, run_id, started, durations, "success")
        metrics = pack(
            reports.run_metrics(
                runs,
                bronze,
                checked.filter("rejection_reason IS NULL"),
                quality.failure_counts(checked, "pipeline_run_id"),
                matched,
            ),
            "metrics",
        )
    layers.append_metrics(metrics, _batch(run_id, started))
    layers.mirror_metrics(metrics)
    return metrics


def replay(
    spark: SparkSession,
    products: DataFrame,
    layers: Layers,
    first_date: str | None = None,
    last_date: str | None = None,
    scorer: str = "weighted",
    at: Column | None = None,
    keep: Callable = pack,
) -> tuple[DataFrame, DataFrame]:
    """Rebuild lines and matches from stored captures of a date range; no new captures."""
    bronze = layers.read_bronze(spark, first_date=first_date, last_date=last_date)
    return refine(bronze, products, layers, scorer, at, keep=keep)


def quarantine_view(quarantine: DataFrame) -> DataFrame:
    """Each rejected line of a run once, however often the run was repeated."""
    keys = ["pipeline_run_id", "source_file_hash", "line_id"]
    return last_wins(quarantine, keys, [F.col("processed_at").desc(), F.col("rejection_reason")])
