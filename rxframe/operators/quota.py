"""Trailing-window admission per client over an access log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxframe import constants as K


def admit(times: np.ndarray, counts: np.ndarray, recent: deque, limit: int, window: int):
    """How many hits of each (sorted) moment are admitted; ``recent`` holds admitted times.

    A full window skips straight to the first moment after its oldest hit has left it.
    """
    admitted = np.zeros(len(times), dtype=np.int64)
    i = 0
    while i < len(times):
        now = times[i]
        while recent and recent[0] < now - window:
            recent.popleft()
        room = limit - len(recent)
        if room <= 0:
            i = int(np.searchsorted(times, recent[0] + window, side="right"))
            continue
        admitted[i] = min(room, counts[i])
        recent.extend([now] * int(admitted[i]))
        i += 1
    return admitted


def _segment_pass(limit: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            key = pd.MultiIndex.from_arrays([batch["client"], batch["segment"]])
            codes = key.factorize()[0]
            edges = np.flatnonzero(np.diff(codes, prepend=-1))
            counts = np.zeros(len(batch), dtype=np.int64)
            times, sizes = batch["at"].to_numpy(), batch["n"].to_numpy()
            for start, stop in zip(edges, [*edges[1:], len(batch)]):
                if key[start] != current:
                    current, recent = key[start], deque()
                counts[start:stop] = admit(
                    times[start:stop], sizes[start:stop], recent, limit, window
                )
            kept = counts > 0
            yield pd.DataFrame(
                {"client": batch["client"][kept], "at": times[kept], "admitted": counts[kept]}
            )

    return run


def admissions(
    log: DataFrame,
    limit: int = K.QUOTA_LIMIT,
    window_seconds: int = K.QUOTA_WINDOW_SECONDS,
) -> DataFrame:
    """log(event_id, client, ts) plus ``admitted``: fewer than ``limit`` admitted hits in the window.

    Hits of one client at one moment are counted before the shuffle. A client's log is cut wherever
    a whole window passes without a hit, so those parts run apart; each part is read as a sorted
    stream with at most ``limit`` remembered times, never as a group in memory.
    """
    window = window_seconds * 1_000_000
    hits = log.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    moments = (
        hits.groupBy("client", "at")
        .agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("n"))
        .withColumn("bucket", F.floor(F.col("at") / window))
    )
    in_order = Window.partitionBy("client").orderBy("bucket")
    gap = F.col("bucket") - F.lag("bucket").over(in_order)
    segments = (
        moments.select("client", "bucket")
        .distinct()
        .withColumn("start", F.when(F.coalesce(gap, F.lit(2)) > 1, F.col("bucket")))
        .withColumn(
            "segment",
            F.max("start").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .select("client", "bucket", "segment")
    )
    client_type = dict(log.dtypes)["client"]
    passed = (
        moments.join(segments, ["client", "bucket"])
        .select("client", "segment", "at", "n")
        .repartition("client", "segment")
        .sortWithinPartitions("client", "segment", "at")
        .mapInPandas(
            _segment_pass(limit, window), f"client {client_type}, at bigint, admitted bigint"
        )
    )
    by_id = Window.partitionBy("client", "at").orderBy("event_id")
    # Only the first ``limit`` hits of a moment can be admitted; the rest never leave their task.
    chosen = (
        hits.select("event_id", "client", "at")
        .withColumn("_rank", F.row_number().over(by_id))
        .filter(F.col("_rank") <= limit)
        .join(passed, ["client", "at"])
        .filter(F.col("_rank") <= F.col("admitted"))
        .select("event_id", F.lit(True).alias("admitted"))
    )
    return log.join(chosen, "event_id", "left").withColumn(
        "admitted", F.coalesce("admitted", F.lit(False))
    )
