"""Telemetry and logs as streams: counted by windows, guarded by a breaker, flushed in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from covenant.functions import text
from covenant.operators import rules

OPEN_AFTER = 3


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and name; events later than ``late`` are passed over, so the state stays bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "name").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "name", "n")


def breaker(events: DataFrame, by: str = "source") -> DataFrame:
    """(source, seq, failures, open) of ``events(source, seq, ok)``: failures in a row up to each event; ``open`` from three on.

    The state of a source is one number. Within a batch events go by ``seq``.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for ok in rows["ok"]:
            failures = 0 if ok else failures + 1
            out.append(failures)
        state.update((failures,))
        yield pd.DataFrame({by: key[0], "seq": rows["seq"].to_numpy(), "failures": out, "open": [f >= OPEN_AFTER for f in out]})

    return events.groupBy(by).applyInPandasWithState(run, f"{by} string, seq long, failures long, open boolean", "failures long", "append", GroupStateTimeout.NoTimeout)


class Breaker:
    """Stands in front of a ``send``: after three failures in a row nothing is sent any more, and a success starts the count anew.

    A batch that isn't sent stays with the stream's source: ``send`` raises ``Open``, the query ends and its checkpoint
    keeps the place. It belongs to one query, whose batches come one after another.
    """

    class Open(Exception):
        """Nothing is sent until a new breaker takes over."""

    def __init__(self, send: Callable[[DataFrame, int], None]):
        self.send, self.failures = send, 0

    def __call__(self, lines: DataFrame, batch: int) -> None:
        while self.failures < OPEN_AFTER:
            try:
                self.send(lines, batch)
            except Exception:  # whatever went wrong counts
                self.failures += 1
            else:
                self.failures = 0
                return
        raise Breaker.Open(f"batch {batch}: {self.failures} failures in a row")


def exported(events: DataFrame, endpoint: str, send: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """``flushed`` to an endpoint behind a breaker; to an endpoint that isn't allowed nothing goes, and the events are dropped."""
    allowed = events.sparkSession.range(1).select(text.allowed_endpoint(F.lit(endpoint))).first()[0]
    return flushed(events, Breaker(send) if allowed else lambda lines, batch: None, checkpoint, every)


def new_call_sites(sources: DataFrame, marker: str = "covenant:") -> DataFrame:
    """Call sites of a stream of source files: each file once, when it comes, so nothing is looked at again."""
    return rules.unvalidated_calls(sources, marker)


def flushed(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a stream that hands each batch, as lines of JSON, to ``send(lines, batch_id)``; all that is there now, or every so often."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: send(df.select(F.to_json(F.struct("*")).alias("value")), k))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
