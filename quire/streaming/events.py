"""Event streams: sequenced bounded logs, progress and throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("finish", "error")
LOG = "execution_id string, sequence long, type string, payload string"


def sequenced(events: DataFrame) -> DataFrame:
    """A stream (execution_id, ts, type, payload) with each execution's events numbered from 1; none after a terminal one."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, closed = state.get if state.exists else (0, False)
        f = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for kind, payload in zip(f["type"], f["payload"], strict=True):
            if closed:
                break
            seq += 1
            out.append((key[0], seq, kind, payload))
            closed = kind in TERMINAL
        state.update((seq, closed))
        yield pd.DataFrame(out, columns=["execution_id", "sequence", "type", "payload"])

    return events.groupBy("execution_id").applyInPandasWithState(number, LOG, "seq long, closed boolean", "append", "NoTimeout")


def sequenced_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table."""
    w = Window.partitionBy("execution_id").orderBy("ts")
    ended = F.max(F.col("type").isin(*TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("sequence", F.row_number().over(w).cast("long")).withColumn("_ended", F.coalesce(ended, F.lit(0)))
    return e.where("_ended = 0").select("execution_id", "sequence", "type", "payload")


def bounded(log: DataFrame, most: int) -> DataFrame:
    """The last `most` events of each execution."""
    last = F.max("sequence").over(Window.partitionBy("execution_id"))
    return log.withColumn("_last", last).where(F.col("sequence") > F.col("_last") - most).drop("_last")


def throttled(events: DataFrame, seconds: float = 0.1, few: int = 3) -> DataFrame:
    """A stream (stage, ts, done, total) without reports that follow the last one of their stage too soon, where a stage has
    more than `few` steps."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        f = pd.concat(list(frames)).sort_values("ts", kind="stable")
        rows = []
        for i, (ts, total) in enumerate(zip(f["ts"], f["total"], strict=True)):
            now = ts.timestamp()
            if last is None or total <= few or now - last >= seconds:
                last = now
                rows.append(i)
        if last is not None:
            state.update((last,))
        yield f.iloc[rows][["stage", "ts", "done", "total"]]

    return events.groupBy("stage").applyInPandasWithState(keep, "stage string, ts timestamp, done long, total long", "last double", "append", "NoTimeout")


def progress(stages: DataFrame) -> DataFrame:
    """Overall progress of 100 of (execution_id, stage, weight, done, total): finished weights and the running one's share."""
    share = F.when(F.col("total") > 0, F.least(F.col("done") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return stages.groupBy("execution_id").agg((100 * F.sum(F.col("weight") * share) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("progress"))


def unfinished(log: DataFrame) -> DataFrame:
    """An error event for each execution whose log has no terminal one."""
    done = log.where(F.col("type").isin(*TERMINAL))
    open_ = log.groupBy("execution_id").agg((F.max("sequence") + 1).alias("sequence")).join(done, "execution_id", "left_anti")
    return open_.select("execution_id", "sequence", F.lit("error").alias("type"), F.lit("ended without a terminal event").alias("payload"))


def windowed_counts(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by type and window of event time, with a watermark; beyond the reference's own operators."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
