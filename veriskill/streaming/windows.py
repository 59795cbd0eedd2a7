"""Accumulation windows over observations that arrive in any order: late ones revise what was given before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriskill.functions import exprs as E
from veriskill.operators import match as J
from veriskill.sources import merge

KEYS = ("day", "cy", "cx", "end", "hours")
LATE = "90 days"
TOGETHER = 1 << 20  # observations of a task that are summed together


def _summed(rows: DataFrame) -> DataFrame:
    """(obs_time, cy, cx, value, n): sums and counts of observations of one time and cell, by task, without a shuffle."""

    def some(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(held).group_by(["obs_time", "cy", "cx"], use_threads=False).aggregate([("value", "sum"), ("value", "count")])
        yield from got.select(["obs_time", "cy", "cx", "value_sum", "value_count"]).rename_columns(["obs_time", "cy", "cx", "value", "n"]).to_batches()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                yield from some(held)
                held, n = [], 0
        if n:
            yield from some(held)

    return rows.mapInArrow(stage, "obs_time timestamp, cy int, cx int, value double, n bigint")


def window_updates(stream: DataFrame, windows: tuple[int, ...] = J.WINDOWS, late: str = LATE, per_degree: int = 100) -> DataFrame:
    """(cy, cx, day, end, hours, obs_rate, n_obs) of every window that a batch of observations has changed.

    `stream` has obs_time (timestamp), latitude, longitude and value. The state of a cell's day is the sum and the count of each
    of its hours and of the few before it that its windows reach back to (these observations go to both days), so that it
    takes an observation whenever it comes, and gives the means of hourly means of the windows it is in anew. What reaches
    the state are each task's sums of a cell and time, not its observations. The
    state of a day goes when the watermark has passed it by `late`; what comes after that is dropped. Null values and
    places take no part.
    """
    back = max(windows) - 1
    rows = stream.where("value IS NOT NULL AND obs_time IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    rows = rows.select("obs_time", E.cell(F.col("latitude"), per_degree).alias("cy"), E.cell(F.col("longitude"), per_degree).alias("cx"), F.col("value").cast("double").alias("value"))
    rows = _summed(rows).withWatermark("obs_time", late)
    hour = F.hour("obs_time")
    own, next_ = F.struct(F.to_date("obs_time").alias("day"), (hour + back).alias("slot")), F.struct(F.date_add(F.to_date("obs_time"), 1).alias("day"), (hour - 24 + back).alias("slot"))
    rows = rows.withColumn("__to", F.explode(F.when(hour >= 24 - back, F.array(own, next_)).otherwise(F.array(own))))
    rows = rows.select("obs_time", "cy", "cx", "__to.day", "__to.slot", "value", "n")

    def revise(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, n = (np.array(x, float) for x in state.get) if state.exists else (np.zeros(back + 24), np.zeros(back + 24))
        new = np.zeros(back + 24)
        for frame in frames:
            slot = frame.slot.to_numpy()
            total += np.bincount(slot, frame.value.to_numpy(float), back + 24)
            new += np.bincount(slot, frame.n.to_numpy(float), back + 24)
        n += new
        day = pd.Timestamp(key[2])
        state.update((total.tolist(), n.astype(int).tolist()))
        state.setTimeoutTimestamp(max(int(day.timestamp() * 1000) + 2 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        mean, out = np.divide(total, n, out=np.zeros(back + 24), where=n > 0), []
        for hours in windows:
            for at in range(24):
                here = slice(at + back - hours + 1, at + back + 1)
                if new[here].any():
                    held = n[here] > 0
                    out.append((*key, day + pd.Timedelta(hours=at), hours, float(mean[here][held].mean()), int(held.sum())))
        yield pd.DataFrame(out, columns=["cy", "cx", "day", "end", "hours", "obs_rate", "n_obs"])

    kinds = "cy int, cx int, day date, end timestamp, hours int, obs_rate double, n_obs bigint"
    return rows.groupBy("cy", "cx", "day").applyInPandasWithState(revise, kinds, "total array<double>, n array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)


def keep_windows(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch of `window_updates` into a keyed table by day; a batch that is run again changes nothing.

    A batch is kept while it is merged, for each pass over it would go through the state again.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            merge.merge(batch, folder, KEYS, ("day",))
        finally:
            batch.unpersist()

    return updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_pairs(forecast: DataFrame, windows: DataFrame, accum: Column, divide: Column | None = None, per_degree: int = 100) -> DataFrame:
    """`match.window_pairs` from a table of kept windows: metrics over them are those of all observations so far."""
    met = windows.select(F.col("cy").alias("__latitude"), F.col("cx").alias("__longitude"), F.col("end").cast("timestamp_ntz").alias("__end"), F.col("hours").alias("__accum"), "obs_rate", "n_obs")
    return J.met_pairs(forecast, met, accum, divide=divide, per_degree=per_degree)
