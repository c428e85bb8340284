"""Structured Streaming: the stateful rate limiter and incremental index maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.index import InvertedIndex
from lodestone.operators.service import LIMIT, WINDOW


def rate_limited_stream(events: DataFrame, key: str, ts: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """A stream of (key, ts timestamp) with ``allowed``; state is the times of a key's accepted events, at most ``limit``.

    Events of one batch are taken in time order; state is dropped when the watermark (one window) passes it.
    """

    def decide(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        allowed = []
        for t in rows["t"]:
            accepted = [a for a in accepted if a > t - window]
            allowed.append(len(accepted) < limit)
            if allowed[-1]:
                accepted.append(float(t))
        state.update((accepted,))
        ends = int(max(rows["t"].max() + window, 0) * 1000) + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "t": rows["t"].to_numpy(), "allowed": allowed})

    timed = events.withWatermark(ts, f"{int(window)} seconds").select(F.col(key).cast("string").alias("key"), F.col(ts), F.col(ts).cast("double").alias("t"))
    return timed.groupBy("key").applyInPandasWithState(decide, "key string, t double, allowed boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def maintain_index(changes: DataFrame, index: InvertedIndex, order: str, checkpoint: str):
    """Keep an inverted index current with a stream of changes (``deleted`` boolean): the highest ``order`` of an id wins,
    also if it comes before an older one, and against deletions.

    Each micro-batch becomes one segment of the index, written from the batch alone; a repeated batch writes it again.
    """
    return changes.writeStream.foreachBatch(lambda batch, number: index.apply(batch, order, segment=number)).option("checkpointLocation", checkpoint)
