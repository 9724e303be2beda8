"""Structured Streaming twins of the trace operators, and incremental mining."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.operators import mining, trace


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, trigger, n, closed by a watermark: state is kept for open hours alone."""
    return trace.hourly(events.withWatermark("ts", late))


def numbered(events: DataFrame) -> DataFrame:
    """trace_id, event_id, seq: a running number for each trace, kept as state. Events of one batch are numbered by time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows["seq"] = range(n, n + len(rows))
        state.update((n + len(rows),))
        yield pd.DataFrame({"trace_id": key[0], "event_id": rows["event_id"], "seq": rows["seq"]})

    own = events.select(F.col("user_id").alias("trace_id"), "event_id", "ts")
    return own.groupBy("trace_id").applyInPandasWithState(run, "trace_id long, event_id long, seq long", "n long", "append", GroupStateTimeout.NoTimeout)


def breaker(calls: DataFrame, most: int = 3, cooldown: float = 60.0, failed: str = "error") -> DataFrame:
    """user_id (the vendor), event_id, short_circuited, opened: `most` failures in a row open the circuit for `cooldown` seconds of
    event time; calls within them are not made and count for nothing; a success resets the count."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        made = []
        for row in rows.itertuples():
            now = row.ts.timestamp()
            if now < until:
                made.append((key[0], row.event_id, True, False))
                continue
            if until:
                failures, until = 0, 0.0
            failures = failures + 1 if row.event_type == failed else 0
            if opened := failures >= most:
                until = now + cooldown
            made.append((key[0], row.event_id, False, opened))
        state.update((failures, until))
        yield pd.DataFrame(made, columns=["user_id", "event_id", "short_circuited", "opened"])

    own = calls.select("user_id", "event_id", "ts", "event_type")
    return own.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, short_circuited boolean, opened boolean", "failures long, until double", "append", GroupStateTimeout.NoTimeout)


def mine_incrementally(docs: DataFrame, path: str, checkpoint: str):
    """A query that adds each batch's n-gram counts under `path`, a folder a batch, so that a batch that runs again replaces itself; merged() adds them up."""

    def add(batch: DataFrame, number: int) -> None:
        mining.frequencies(mining.occurrences(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("n", "term").agg(F.sum("freq").alias("freq"), F.min("first_seen").alias("first_seen"))
