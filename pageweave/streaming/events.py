"""The event log as a stream: health windows with a watermark, and a watchdog with per-page state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageweave.operators import events as E

TIMEOUTS = dict(enumerate(E.STAGE_TIMEOUTS.values()))
SCHEMA = "event_id long, ts timestamp, page_id long, event string, stage int, latency_ms double"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def health(events: DataFrame, late: str = "10 minutes", width: str = "30 seconds") -> DataFrame:
    out = E.health(events.withWatermark("ts", late), width)
    return out.select(F.col("w.start").alias("w_start"), "event", "n")


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    page = key[0]
    if state.hasTimedOut:
        stage, since = state.get
        state.remove()
        yield pd.DataFrame({"page_id": [page], "stage": [stage], "since_ms": [since]})
        return
    for b in batches:
        last = b.sort_values(["ts", "event_id"]).iloc[-1]
        if last["event"] == "stage_start":
            state.update((int(last["stage"]), int(last["ts"].timestamp() * 1000)))
        elif state.exists:
            state.remove()
    if state.exists:
        stage, since = state.get
        state.setTimeoutTimestamp(max(since + 1000 * TIMEOUTS.get(stage, E.OTHER_TIMEOUT), state.getCurrentWatermarkMs() + 1))


def watchdog(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Pages whose last event is a stage start older than the stage's timeout by the watermark; each freeze is told once."""
    return events.withWatermark("ts", late).groupBy("page_id").applyInPandasWithState(_watch, "page_id long, stage int, since_ms long", "stage int, since_ms long", "append", GroupStateTimeout.EventTimeTimeout)
