"""The glossary as pages are translated: a stream of what pages write and ask for, with the state of each term."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "ts timestamp, page_id long, term string, dst string"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
    if not state.hasTimedOut:
        for b in batches:
            waiting += [[int(t.timestamp() * 1000), int(p), None if pd.isna(d) else d] for t, p, d in zip(b["ts"], b["page_id"], b["dst"], strict=True)]
    # in order of pages, what a page asks for before what it writes; later rows of a page with the same term win
    waiting.sort(key=lambda r: (r[1], r[2] is not None, r[0]))
    passed = state.getCurrentWatermarkMs()
    out = []
    while waiting and waiting[0][0] <= passed:
        _, page, dst = waiting.pop(0)
        if dst is None:
            out.append((page, key[0], known))
        else:
            known = dst
    state.update((known, json.dumps(waiting)))
    if waiting:
        state.setTimeoutTimestamp(max(min(r[0] for r in waiting), passed) + 1)
    yield pd.DataFrame(out, columns=["page_id", "term", "dst"])


def as_of(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """page_id, term, dst for each row that asks (dst null): what pages before it had written, rows that write having dst.

    Times rise with pages. Rows wait until the watermark has passed them, so those that come late, within ``late``, are in their place; a term's state is its
    last translation and the rows that wait.
    """
    asked = rows.withWatermark("ts", late).groupBy("term")
    return asked.applyInPandasWithState(_follow, "page_id long, term string, dst string", "known string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
