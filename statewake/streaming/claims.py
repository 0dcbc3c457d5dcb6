"""Claims and outcomes over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLAIM = "user_id long, text string, revision int, valid_from timestamp"


def _revise(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, revision = state.get if state.exists else (None, 0)
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        if r.event_type != text:
            text, revision = r.event_type, revision + 1
            out.append((key[0], text, revision, r.ts))
    state.update((text, revision))
    yield pd.DataFrame(out, columns=["user_id", "text", "revision", "valid_from"])


def revisions(events: DataFrame) -> DataFrame:
    """A new revision of a user's claim whenever its text changes; events(user_id, event_id, event_type, ts timestamp) in order of time across batches. The state is one text and number a user."""
    return events.select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandasWithState(_revise, CLAIM, "text string, revision int", "append", GroupStateTimeout.NoTimeout)


def outcome_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's sessions: runs of events with gaps below the limit."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
