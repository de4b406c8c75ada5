"""Streams with state of their own: keyed processors with timers, event-time windows, and the table of their last rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.session import scratch

WEEK_US = 7 * 86_400_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
YIELDS = "source_id long, window_us long, yielded long"


class AnchoredCounter(StatefulProcessor):
    """A 7-day counter for each source, begun at its first success and anew at the first success 7 days or more later.

    Where a window begins hangs on all successes before it, so rows wait in ``pending`` until
    the watermark has passed them, and only then move the ``settled`` window on, in order of
    time. What is reported is the settled window moved on over what is pending, so it is right
    for all rows that came so far, in whatever order. A timer settles sources that fell silent,
    so a source that sends nothing holds one row of state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "start long, total long")
        self.pending = handle.getListState("pending", "us long, items long")

    def held(self) -> tuple[tuple[int | None, int], list[tuple[int, int]]]:
        window = self.settled.get() if self.settled.exists() else (None, 0)
        return (window[0], window[1]), [(r[0], r[1]) for r in self.pending.get()] if self.pending.exists() else []

    @staticmethod
    def moved(window: tuple[int | None, int], rows: list[tuple[int, int]]) -> tuple[int | None, int]:
        start, total = window
        for us, items in rows:
            if start is None or us >= start + WEEK_US:
                start, total = us, 0
            total += items
        return start, total

    def settle(self, window: tuple[int | None, int], rows: list[tuple[int, int]], mark_ms: int) -> tuple[tuple[int | None, int], list[tuple[int, int]]]:
        """Moves the window over the rows that the watermark has passed, and keeps the others."""
        rows = sorted(rows)
        done = [r for r in rows if r[0] < mark_ms * 1000]
        rest = rows[len(done) :]
        if done:
            window = self.moved(window, done)
            self.settled.update(window)
        if rest:
            self.pending.put(rest)
        elif self.pending.exists():
            self.pending.clear()
        return window, rest

    def row(self, key: tuple, window: tuple[int | None, int], rest: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        start, total = self.moved(window, rest)
        yield pd.DataFrame({"source_id": [key[0]], "window_us": [start], "yielded": [total]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window, waiting = self.held()
        for pdf in rows:
            waiting += zip(pdf["us"].tolist(), pdf["items"].tolist())
        mark = timerValues.getCurrentWatermarkInMs()
        window, rest = self.settle(window, waiting, mark)
        if rest:
            self.handle.registerTimer(max(rest[-1][0] // 1000, mark) + 1)
        yield from self.row(key, window, rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, waiting = self.held()
        window, rest = self.settle(window, waiting, timerValues.getCurrentWatermarkInMs())
        yield from self.row(key, window, rest)

    def close(self) -> None:
        pass


def anchored_counts(successes: DataFrame, lateness: str) -> DataFrame:
    """The stream of counters, a row each time a source's changes, of a stream of (source_id, ts, items)."""
    rows = successes.select(F.col("source_id").cast("long").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("items").cast("long").alias("items"))
    keyed = rows.withWatermark("at", lateness).groupBy("source_id")
    return keyed.transformWithStateInPandas(statefulProcessor=AnchoredCounter(), outputStructType=YIELDS, outputMode="Update", timeMode="EventTime")


def hourly(events: DataFrame, lateness: str) -> DataFrame:
    """The stream of hours (hour, n, latest) of a stream of events; an hour's state goes when the watermark has passed it."""
    rows = events.select(F.col("ts").cast("timestamp").alias("at"))
    hours = rows.withWatermark("at", lateness).groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("at").alias("latest"))
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", F.col("latest").cast("timestamp_ntz").alias("latest"))


def last_rows(changes: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(the last row of each key, rows that came too late) of a bounded stream in update mode, run to its end.

    The rows that a micro-batch changed are written under its number, and written over when
    it runs again, so a batch that fails half-way counts once.
    """
    spark, schema = changes.sparkSession, changes.schema
    base, before = scratch(spark, "keyed"), spark.conf.get(STORE)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    # keyed processors keep their state in RocksDB; a query takes the setting as it starts
    spark.conf.set(STORE, ROCKS)
    try:
        run = changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    run.awaitTermination()
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in run.recentProgress for s in p["stateOperators"])
    fields = [f.name for f in schema]
    if not run.recentProgress or all(p["numInputRows"] == 0 for p in run.recentProgress):
        return spark.createDataFrame([], schema), late
    rows = spark.read.schema(schema.add("epoch", "long")).parquet(f"{base}/rows")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), "epoch").alias("r"))
    return last.select("r.*"), late
