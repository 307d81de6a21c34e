"""Streams of snapshots, membership and suspicion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import membership
from ..session import share_code


def snapshots(events: DataFrame, every: str = "2 seconds", late: str = "10 seconds", at: str = "ts") -> DataFrame:
    """Counts per interval and type, as a batch or as a stream; a stream forgets intervals once they are ``late``."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def write_snapshots(frames: DataFrame, send: Callable[[DataFrame, int], None], every: str = "2 seconds", checkpoint: str | None = None):
    """Send a stream's current frame to ``send`` (frame, number) at once and then after each interval. A frame that can not be
    made is skipped; an error of ``send`` itself, as of a client that has gone, ends the query. Returns the running query."""

    def one(frame: DataFrame, number: int) -> None:
        try:
            frame = frame.persist()
            frame.count()
        except AnalysisException:
            return
        try:
            send(frame, number)
        finally:
            frame.unpersist()

    writer = frames.writeStream.outputMode("complete").trigger(processingTime=every).foreachBatch(one)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def merged_members(rumours: DataFrame) -> DataFrame:
    """The winning news of each member; over a stream, an update whenever a member's changes."""
    return membership.merge(rumours)


def suspicions(ticks: DataFrame, after: int = membership.SUSPICION_TICKS) -> DataFrame:
    """Members that die of suspicion in a stream (id, tick, severity): a suspect that is not heard alive for ``after``
    ticks. Logical ticks come as a column, so the state holds the tick of the suspicion and no clock is read."""
    share_code(ticks.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else -1
        out = []
        for rows in [pd.concat(list(parts)).sort_values("tick")]:
            for tick, severity in zip(rows["tick"], rows["severity"], strict=True):
                if since >= 0 and tick - since >= after:
                    out.append((key[0], since + after))
                    since = -1
                if severity == membership.SUSPECT:
                    since = tick if since < 0 else since
                else:
                    since = -1
        state.update((since,))
        yield pd.DataFrame(out, columns=["id", "tick"])

    return ticks.groupBy("id").applyInPandasWithState(run, "id string, tick bigint", "since bigint", "append", "NoTimeout")
