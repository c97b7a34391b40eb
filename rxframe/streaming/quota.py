"""The same admission rule on a stream."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rxframe import constants as K
from rxframe.operators.quota import admit


def admissions(
    log: DataFrame,
    limit: int = K.QUOTA_LIMIT,
    window_seconds: int = K.QUOTA_WINDOW_SECONDS,
    late_seconds: int | None = None,
) -> DataFrame:
    """Stream of (event_id, client, at, admitted); ``at`` is in microseconds.

    Per client only the times of its last admitted hits are kept, ``limit`` of them at most. An event-time timer drops
    them once the watermark, ``late_seconds`` (a window, if not given) behind the latest hit, has passed the end of
    their window, so the state holds recent clients only.

    Hits are taken in time order within a micro-batch, whose size the source bounds. A hit that comes after a micro-batch
    with later admitted hits is judged at the time of the last of these. A hit at or behind the watermark of the
    micro-batches before gives no row: it is not admitted and counts for nothing.
    """
    window = window_seconds * 1_000_000
    late = window_seconds if late_seconds is None else late_seconds

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs() * 1000
        recent = deque(state.get[0] if state.exists else [])
        rows = pd.concat([f[["event_id", "at"]] for f in frames]).sort_values(["at", "event_id"])
        times = rows["at"].to_numpy()
        judged = np.maximum(times, recent[-1]) if recent else times
        admitted = admit(judged, np.ones(len(judged), dtype=np.int64), recent, limit, window) > 0
        if recent:
            state.update(([int(t) for t in recent],))
            # A hit at the very end of the window still counts the last one.
            state.setTimeoutTimestamp(max(int(recent[-1] + window), watermark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], "client": key[0], "at": times, "admitted": admitted})

    client_type = dict(log.dtypes)["client"]
    hits = log.select("event_id", "client", F.col("ts").cast("timestamp").alias("ts"))
    return (
        hits.withWatermark("ts", f"{late} seconds")
        .withColumn("at", F.unix_micros("ts"))
        .groupBy("client")
        .applyInPandasWithState(
            run,
            f"event_id bigint, client {client_type}, at bigint, admitted boolean",
            "recent array<bigint>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
