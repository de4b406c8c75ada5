"""Bitemporal reads over append-only versions.

A version row has ``item_key``, ``fetched_at`` and ``ingest_seq`` (monotone per append, so
it breaks ties). Every read is one aggregation by key that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row per key in ``order`` (later columns break ties)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def current(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The version in force now: newest fetched_at, then ingest_seq."""
    return newest(versions, keys, "fetched_at", "ingest_seq")


def as_of(versions: DataFrame, keys: list[str], instant: str, horizon: str | None = None) -> DataFrame:
    """The version in force at ``instant`` (inclusive); an instant before the retention horizon is an error."""
    if horizon is not None and instant < horizon:
        raise ValueError(f"{instant} is before the retention horizon {horizon}")
    return current(versions.where(F.col("fetched_at") <= F.lit(instant).cast("timestamp")), keys)


def upsert_if_newer(stored: DataFrame, seen: DataFrame, keys: list[str], observed: str) -> DataFrame:
    """Strictly newer observations replace, older or equal ones are ignored: rows with ``action``."""
    rest = [c for c in seen.columns if c not in keys]
    best = newest(seen, keys, observed, *[c for c in rest if c != observed])
    old = stored.select(*keys, F.struct(*rest).alias("_old"))
    new = best.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, keys, "full_outer")
    newer = F.col(f"_new.{observed}") > F.col(f"_old.{observed}")
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(newer, "updated").otherwise("ignored")
    row = F.when(F.col("_old").isNull() | F.coalesce(newer, F.lit(False)), F.col("_new")).otherwise(F.col("_old"))
    return both.withColumn("_row", row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], action.alias("action"))


def replay_state(log: DataFrame) -> DataFrame:
    """(item_key, read_at, saved_at, dismissed_at, signals) of an ordered event log.

    Read, save and dismiss are idempotent (the first wins), unsave clears; every dismissal
    that changes the state emits one signal, so at most one.
    """
    at = lambda kind: F.col("action") == kind
    unsaved = F.max(F.when(at("unsave"), F.struct("ts", "seq")))
    events = log.groupBy("item_key").agg(
        F.min(F.when(at("read"), F.col("ts"))).alias("read_at"),
        F.min(F.when(at("dismiss"), F.col("ts"))).alias("dismissed_at"),
        F.array_sort(F.collect_list(F.when(at("save"), F.struct("ts", "seq")))).alias("saves"),
        unsaved.alias("cleared"),
    )
    after = F.filter("saves", lambda s: F.col("cleared").isNull() | (s > F.col("cleared")))
    return events.select("item_key", "read_at", F.get(after, F.lit(0))["ts"].alias("saved_at"), "dismissed_at", F.col("dismissed_at").isNotNull().cast("int").alias("signals"))


def keep_answers(attempts: DataFrame, keys: list[str], observed: str, seq: str, answer: list[str], attempt: list[str], first: list[str]) -> DataFrame:
    """Field-preserving upsert of ordered attempts: one row per key.

    ``answer`` columns come together from the last attempt that has the first of them, so a
    failed attempt erases none; ``attempt`` columns come from the last attempt of all;
    ``first`` columns keep their first value that is not null.
    """
    order = F.struct(observed, seq)
    answered = F.col(answer[0]).isNotNull()
    folded = attempts.groupBy(*keys).agg(
        F.max_by(F.struct(*answer, F.col(observed).alias("answered_at")), F.when(answered, order)).alias("_a"),
        F.max_by(F.struct(*attempt, F.col(observed).alias("attempted_at")), order).alias("_t"),
        F.min(observed).alias("first_attempted_at"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in first],
    )
    return folded.select(*keys, "_a.*", "_t.*", "first_attempted_at", *first)


def worklist(candidates: DataFrame, answers: DataFrame, key: str, now: str, most: int) -> DataFrame:
    """The first ``most`` candidates: never tried, tried in vain, stale, fresh.

    Tried in vain: oldest attempt first; stale: oldest answer first; others: most stars
    first. A prose answer stays fresh for 30 days, any other answer for 24 hours.
    """
    window = F.when(F.col("outcome") == "present", F.expr("interval 30 days")).otherwise(F.expr("interval 24 hours"))
    fresh = F.col("answered_at") > F.lit(now).cast("timestamp_ntz") - window
    tier = F.when(F.col("attempted_at").isNull(), 0).when(F.col("outcome").isNull(), 1).when(fresh, 3).otherwise(2)
    rows = candidates.join(answers.select(key, "outcome", "answered_at", "attempted_at"), key, "left").withColumn("tier", tier)
    waited = F.when(F.col("tier") == 1, F.col("attempted_at")).when(F.col("tier") == 2, F.col("answered_at"))
    stars = F.when(F.col("tier").isin(0, 3), F.col("stars"))
    return rows.orderBy("tier", waited, stars.desc(), key).limit(most)


def append(items: DataFrame, path: str, bridges: dict[str, str]) -> None:
    """Appends versions, by day of fetch, and one bridge row per value of each array column in ``bridges`` (column: path)."""
    day = F.to_date("fetched_at").alias("fetch_date")
    items.drop(*bridges).withColumn("fetch_date", day).write.mode("append").partitionBy("fetch_date").parquet(path)
    for column, at in bridges.items():
        items.select("item_id", F.explode(F.array_distinct(column)).alias(column.rstrip("s"))).write.mode("append").parquet(at)


def append_stream(items: DataFrame, path: str, bridges: dict[str, str], progress: str) -> None:
    """Continuous ingest: a bounded stream of items is appended to its end; file sinks commit each micro-batch once."""
    day = F.to_date("fetched_at").alias("fetch_date")
    running = [items.drop(*bridges).withColumn("fetch_date", day).writeStream.format("parquet").partitionBy("fetch_date").option("path", path).option("checkpointLocation", f"{progress}/items").trigger(availableNow=True).start()]
    for column, at in bridges.items():
        rows = items.select("item_id", F.explode(F.array_distinct(column)).alias(column.rstrip("s")))
        running.append(rows.writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{progress}/{column}").trigger(availableNow=True).start())
    for q in running:
        q.awaitTermination()
