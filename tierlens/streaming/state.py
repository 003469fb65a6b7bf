"""Counts and runs as state with event-time timers; what is still open at a stop is read from the state itself.

Everything that leaves a state is a part that merges: a window's count adds up,
its first details are the smallest of the parts' details, runs join where the
gap between them allows.  A row that comes after its window or run was handed
out opens a new part, so rows are counted once in any order, in any number of
micro-batches and over any number of restarts.  The watermark decides only when
a part leaves the state.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Timers and list states need the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class WindowCounts(StatefulProcessor):
    """Rows of one kind in one window: how many, and the `k` smallest details."""

    def __init__(self, detail: T.DataType, length_micros: int, k: int):
        self.detail, self.length, self.k = detail, length_micros, k

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "events long")
        self.details = handle.getListState("details", T.StructType([T.StructField("detail", self.detail)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        known = held is not None
        events = held[0] if known else 0
        first = [r[0] for r in self.details.get()] if known else []
        for batch in rows:
            events += len(batch)
            first = sorted([*first, *batch["detail"].dropna().sort_values().head(self.k).tolist()])[: self.k]
        self.open.update((events,))
        self.details.put([(v,) for v in first])
        if not known:
            self.handle.registerTimer((key[1] + self.length) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is not None:
            first = [r[0] for r in self.details.get()]
            yield pd.DataFrame({"kind": [key[0]], "window_start": [key[1]], "events": [held[0]], "details": [first]})
            self.open.clear()
            self.details.clear()

    def close(self) -> None:
        pass


class GapRuns(StatefulProcessor):
    """Open runs of one key: rows at most `gap` apart form a run."""

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "run_start long, run_end long, parts long")

    def _merged(self, runs: np.ndarray) -> np.ndarray:
        """Runs (start, end, parts) joined where the gap allows."""
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        far = np.maximum.accumulate(runs[:, 1])
        opens = np.append(True, runs[1:, 0] - far[:-1] > self.gap)
        at = np.flatnonzero(opens)
        return np.stack([runs[at, 0], np.maximum.reduceat(runs[:, 1], at), np.add.reduceat(runs[:, 2], at)], 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(r) for r in self.runs.get()]
        runs = np.array(known, np.int64).reshape(-1, 3)
        for batch in rows:
            at = batch["at"].to_numpy(np.int64)
            runs = self._merged(np.concatenate([runs, np.stack([at, at, np.ones_like(at)], 1)]))
        self.runs.put([tuple(int(v) for v in r) for r in runs])
        if not known:
            self._wait(runs)
        return iter(())

    def _wait(self, runs: np.ndarray) -> None:
        self.handle.registerTimer(int(runs[:, 1].min() + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = np.array([tuple(r) for r in self.runs.get()], np.int64).reshape(-1, 3)
        if not len(runs):
            return
        over = runs[:, 1] + self.gap < timerValues.getCurrentWatermarkInMs() * 1000
        kept = runs[~over]
        self.runs.clear()
        if len(kept):
            self.runs.put([tuple(int(v) for v in r) for r in kept])
            self._wait(kept)
        if over.any():
            done = runs[over]
            yield pd.DataFrame({"key": [key[0]] * len(done), "run_start": done[:, 0], "run_end": done[:, 1], "parts": done[:, 2]})

    def close(self) -> None:
        pass


def _micros(length: str) -> int:
    """A day-time interval such as `2 hours` in microseconds."""
    return int(pd.Timedelta(length).value // 1000)


def _drained(parts: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a stream of parts over everything available and returns all parts handed out, in this run and before."""
    spark = parts.sparkSession
    with _state_store(spark):
        query = (
            parts.writeStream.format("parquet").option("path", f"{checkpoint}/parts").option("checkpointLocation", f"{checkpoint}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(parts.schema).parquet(f"{checkpoint}/parts")


def _open_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame | None:
    """What a state variable holds after the last finished micro-batch; None before the first one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/state")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.format("statestore").option("path", f"{checkpoint}/state").option("stateVarName", variable).load()


def window_counts(events: DataFrame, ts: str, kind: str, detail: str, window: str, watermark: str, checkpoint: str, k: int = 5) -> DataFrame:
    """Drains a stream of events: (window_start, kind, events, details) per tumbling window and kind, as a batch table.

    details are the k smallest values of `detail`.  A second call with the
    same checkpoint goes on where the first one stopped and returns the whole
    table.  Rows without an event time belong to no window; a null kind is a kind.
    """
    spark = events.sparkSession
    kinds, details = events.schema[kind].dataType, events.schema[detail].dataType
    # the window's start is a plain number here: rows behind the watermark are kept
    placed = events.withWatermark(ts, watermark).select(
        F.col(kind).alias("kind"), F.unix_micros(F.window(ts, window)["start"]).alias("window_start"), F.col(detail).alias("detail")
    )
    schema = T.StructType([
        T.StructField("kind", kinds), T.StructField("window_start", T.LongType()), T.StructField("events", T.LongType()), T.StructField("details", T.ArrayType(details)),
    ])
    with _state_store(spark):
        parts = placed.groupBy("kind", "window_start").transformWithStateInPandas(WindowCounts(details, _micros(window), k), schema, "Append", "EventTime")
        table = _drained(parts, checkpoint)
    counted, first = _open_state(spark, checkpoint, "open"), _open_state(spark, checkpoint, "details")
    if counted is not None:
        none = F.array().cast(T.ArrayType(details))
        table = table.unionByName(counted.select("key.kind", "key.window_start", F.col("value.events").alias("events"), none.alias("details")))
        table = table.unionByName(first.select("key.kind", "key.window_start", F.lit(0).cast("long").alias("events"), F.array("list_element.detail").alias("details")))
    whole = table.groupBy("window_start", "kind").agg(F.sum("events").alias("events"), F.flatten(F.collect_list("details")).alias("details"))
    return whole.select(
        F.timestamp_micros("window_start").alias("window_start"), F.col("kind").alias(kind), "events", F.slice(F.sort_array("details"), 1, k).alias("details")
    )


def first_details(counts: DataFrame, kind: str, detail: str, k: int = 5) -> DataFrame:
    """(kind, failures, detail, detail_rank) from window counts: the total per kind and its k smallest details."""
    totals = counts.groupBy(kind).agg(F.sum("events").alias("failures"))
    ranked = counts.select(kind, F.explode("details").alias(detail))
    ranked = ranked.withColumn("detail_rank", F.row_number().over(Window.partitionBy(kind).orderBy(detail))).where(F.col("detail_rank") <= k)
    match: Column = ranked[kind].eqNullSafe(totals[kind])
    return ranked.join(totals, match).select(ranked[kind], "failures", detail, "detail_rank")


def gap_runs(events: DataFrame, ts: str, key: str, gap: str, watermark: str, checkpoint: str) -> DataFrame:
    """Drains a stream of events: (key, run_start, run_end, parts) per run of events at most `gap` apart, as a batch table.

    A second call with the same checkpoint goes on where the first one
    stopped; runs that events of both calls form are one run.  Rows without an
    event time belong to no run.
    """
    spark = events.sparkSession
    placed = events.withWatermark(ts, watermark).where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(ts).alias("at"))
    schema = T.StructType([T.StructField("key", events.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("run_start", "run_end", "parts")]])
    with _state_store(spark):
        parts = placed.groupBy("key").transformWithStateInPandas(GapRuns(_micros(gap)), schema, "Append", "EventTime")
        table = _drained(parts, checkpoint)
    held = _open_state(spark, checkpoint, "runs")
    if held is not None:
        table = table.unionByName(held.select("key.key", "list_element.run_start", "list_element.run_end", "list_element.parts"))
    order = Window.partitionBy("key").orderBy("run_start", "run_end")
    reach = F.max("run_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("run_start") - reach > _micros(gap)).cast("int"), F.lit(1))
    run = table.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = run.groupBy("key", "_run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("parts").alias("parts"))
    return joined.select(F.col("key").alias(key), F.timestamp_micros("run_start").alias("run_start"), F.timestamp_micros("run_end").alias("run_end"), "parts")
