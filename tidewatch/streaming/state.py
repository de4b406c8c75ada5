"""Source state: batch replay and streaming twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVAL_H, LEAST_CAP_H = 1.0, 6.0


PLACE = "struct<ts: timestamp_ntz, seq: bigint>"
SOURCE_STATE = f"source_id long, s {PLACE}, f {PLACE}, after array<{PLACE}>"
ITEM_STATE = f"item_key long, read_at timestamp_ntz, dismissed_at timestamp_ntz, cleared {PLACE}, saves array<{PLACE}>"


def behind(places: Column, mark: Column) -> Column:
    """The places that lie after ``mark``, or all where there is none."""
    return F.filter(places, lambda p: mark.isNull() | (p > mark))


def _sources(log: DataFrame, since: Column) -> DataFrame:
    """(source_id, s, f, since) of an attempt log: places of the last success and failure, and ``since`` of the failures after that success."""
    place = F.struct("ts", "seq")
    last = log.groupBy("source_id").agg(F.max(F.when(F.col("ok"), place)).alias("s"), F.max(F.when(~F.col("ok"), place)).alias("f"))
    fails = log.where(~F.col("ok")).join(last.select("source_id", "s"), "source_id").where(F.col("s").isNull() | (place > F.col("s")))
    return last.join(fails.groupBy("source_id").agg(since.alias("since")), "source_id", "left")


def placed_sources(log: DataFrame) -> DataFrame:
    """Source states that later and earlier batches can be folded into: they hold the places of the failures after the last success.

    Such failures are few, as each doubles the wait for the next attempt.
    """
    rows = _sources(log, F.collect_list(F.struct("ts", "seq")))
    return rows.select("source_id", "s", "f", F.coalesce("since", F.array().cast(f"array<{PLACE}>")).alias("after"))


def next_polls(states: DataFrame) -> DataFrame:
    """(source_id, last_success_at, last_failure_at, consecutive_failures, next_eligible_at) of places ``s`` and ``f`` and the failures ``n`` between."""
    n = F.col("n").cast("long")
    wait = F.when(n > 0, F.least(INTERVAL_H * F.pow(F.lit(2.0), n), F.lit(max(LEAST_CAP_H, INTERVAL_H)))).otherwise(F.lit(INTERVAL_H))
    at = F.greatest(F.col("s.ts"), F.col("f.ts"))
    return states.select("source_id", F.col("s.ts").alias("last_success_at"), F.col("f.ts").alias("last_failure_at"), n.alias("consecutive_failures"), F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + (wait * 3600e6).cast("long")).cast("timestamp_ntz").alias("next_eligible_at"))


def replay_sources(log: DataFrame) -> DataFrame:
    """Source states of an attempt log (source_id, ts, seq, ok), with the time of the next poll.

    A success resets the failures; after n of them the next attempt waits
    min(interval * 2**n, max(6 h, interval)). Everything follows from the last success and
    the failures after it, so one aggregation replays the log.
    """
    return next_polls(_sources(log, F.count("*")).withColumn("n", F.coalesce("since", F.lit(0))))


def fold_sources(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """Source states after a batch of attempts, which may be later or earlier than those before.

    Places tell what came last, not batches: the later success stands, and of the failures
    of both sides those behind it count.
    """
    new = placed_sources(batch)
    if state is None:
        return new
    both = _sides(state, new, "source_id")
    s = F.greatest("o.s", "b.s")
    return both.select("source_id", s.alias("s"), F.greatest("o.f", "b.f").alias("f"), behind(_joined("after"), s).alias("after"))


def fold_items(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """Item states after a batch of actions in any order: first read, save and dismissal win; unsave clears the saves before it."""
    at = lambda kind, what: F.when(F.col("action") == kind, what)
    place = F.struct("ts", "seq")
    new = batch.groupBy("item_key").agg(F.min(at("read", F.col("ts"))).alias("read_at"), F.min(at("dismiss", F.col("ts"))).alias("dismissed_at"), F.max(at("unsave", place)).alias("cleared"))
    saves = batch.where("action = 'save'").join(new.select("item_key", "cleared"), "item_key").where(F.col("cleared").isNull() | (place > F.col("cleared")))
    saves = saves.groupBy("item_key").agg(F.collect_list(place).alias("saves"))
    new = new.join(saves, "item_key", "left").select("item_key", "read_at", "dismissed_at", "cleared", F.coalesce("saves", F.array().cast(f"array<{PLACE}>")).alias("saves"))
    if state is None:
        return new
    both, cleared = _sides(state, new, "item_key"), F.greatest("o.cleared", "b.cleared")
    return both.select("item_key", F.least("o.read_at", "b.read_at").alias("read_at"), F.least("o.dismissed_at", "b.dismissed_at").alias("dismissed_at"), cleared.alias("cleared"), behind(_joined("saves"), cleared).alias("saves"))


def _sides(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new rows of each key side by side, as structs ``o`` and ``b``."""
    fields = [c for c in new.columns if c != key]
    return state.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("b")), key, "full_outer")


def _joined(field: str) -> Column:
    none = F.array().cast(f"array<{PLACE}>")
    return F.concat(F.coalesce(F.col(f"o.{field}"), none), F.coalesce(F.col(f"b.{field}"), none))


def item_states(states: DataFrame) -> DataFrame:
    """(item_key, read_at, saved_at, dismissed_at, signals) of item states; a dismissal emits one signal."""
    return states.select("item_key", "read_at", F.array_min("saves")["ts"].alias("saved_at"), "dismissed_at", F.col("dismissed_at").isNotNull().cast("int").alias("signals"))


def drained(spark: SparkSession, stream: DataFrame, fold: Callable[[DataFrame, DataFrame | None], DataFrame], schema: str) -> DataFrame:
    """Runs a bounded stream to its end; each micro-batch is folded into the keyed state table.

    ``fold(batch, state)`` gives the new state. Versions of the state are written side by
    side, so a batch that is run again after a failure starts from the same state.
    """
    from tidewatch.session import scratch

    base = scratch(spark, "stream")

    def step(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        state = own.read.schema(schema).parquet(f"{base}/state-{epoch - 1}") if epoch else None
        fold(batch, state).write.mode("overwrite").parquet(f"{base}/state-{epoch}")
        done.append(epoch)

    done: list[int] = []
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/state-{max(done)}")


def keep_latest(batch: DataFrame, state: DataFrame | None, keys: list[str], observed: list[str]) -> DataFrame:
    """Keep-latest state that only moves forward: late or equal readings are ignored."""
    from tidewatch.operators.versions import newest

    best = newest(batch, keys, *observed)
    return best if state is None else newest(state.unionByName(best), keys, *observed)
