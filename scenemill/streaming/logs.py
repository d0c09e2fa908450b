"""Streaming counterparts of the batch log operators (extensions: the batch ones are the reference behaviour)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow_log(spark: SparkSession, path: str, schema: str, token: str, max_files: int = 1000) -> DataFrame:
    """An append-only JSON log as a stream, each token once; torn lines are left out. The checkpoint resumes it."""
    rows = spark.readStream.schema(f"{schema}, __torn string").option("columnNameOfCorruptRecord", "__torn").option("maxFilesPerTrigger", max_files).json(path)
    return rows.where("__torn is null").drop("__torn").dropDuplicates([token])


def event_time_counts(stream: DataFrame, ts: str, by: list[str], late: str, window: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; state is dropped once the watermark has passed."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return rows.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def consecutive_failures(stream: DataFrame, key: str, failed: str, error: str, most: int = 5) -> DataFrame:
    """Per key the longest current run of parse failures and whether it reached ``most``; backend errors neither count nor reset."""

    def fold(keys: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, stopped = state.get if state.exists else (0, False)
        for frame in frames:
            for bad, ours in zip(frame[failed], frame[error]):
                if not ours:
                    run = run + 1 if bad else 0
                    stopped = stopped or run >= most
        state.update((run, stopped))
        yield pd.DataFrame({key: [keys[0]], "run": [run], "stopped": [stopped]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, run int, stopped boolean", "run int, stopped boolean", "update", GroupStateTimeout.NoTimeout)


def online_hysteresis(stream: DataFrame, key: str, t: str, column: str, enter: float, leave: float) -> DataFrame:
    """Events as soon as they end, over a stream whose rows come in order per key: the state is the open event."""

    def fold(keys: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, hit, peak = state.get if state.exists else (None, None, False, 0.0)
        out = []
        for frame in frames:
            for at, x in frame.sort_values(t)[[t, column]].itertuples(index=False):
                if abs(x) > leave:
                    start, end = at if start is None else start, at
                    hit, peak = hit or abs(x) > enter, x if abs(x) > abs(peak) else peak
                elif start is not None:
                    if hit:
                        out.append((keys[0], start, end, peak))
                    start, end, hit, peak = None, None, False, 0.0
        state.update((start, end, hit, peak))
        yield pd.DataFrame(out, columns=[key, "start", "end", "peak"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, start double, end double, peak double", "start double, end double, hit boolean, peak double", "append", GroupStateTimeout.NoTimeout
    )
