"""Stored tables that are written in steps: upserts by bucket, and sweeps with a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewatch.operators.versions import newest, upsert_if_newer
from tidewatch.session import stored

BUCKETS = 32


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert_into(path: str, seen: DataFrame, keys: list[str], observed: str, buckets: int = BUCKETS, single: bool = False) -> DataFrame:
    """Puts observations into a stored table, and returns (keys, action): inserted, updated or ignored for each key that was seen.

    The table is parted by a hash of the keys. Only parts that the batch has keys of are
    read, only parts with newer rows are written, each replaced as a whole; a second run
    of the same batch ignores every key and writes nothing. Of one key's rows the last counts; ``single`` tells
    that ``seen`` is stored and has one row a key. Into an empty table rows go as they are.
    """
    spark = seen.sparkSession
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    if single:
        new = seen.withColumn("bucket", bucket)
    else:
        new = stored(newest(seen, keys, observed, *[c for c in seen.columns if c not in (*keys, observed)]).withColumn("bucket", bucket), "upsert-new")
    held = read(spark, path)
    if held is None:
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return new.select(*keys, F.lit("inserted").alias("action"))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    held = held.select(*new.columns)
    merged = stored(upsert_if_newer(held.where(F.col("bucket").isin(touched)), new, [*keys, "bucket"], observed), "upsert-merged")
    moved = merged.where(F.col("action").isin("inserted", "updated"))
    changed = sorted(r.bucket for r in moved.select("bucket").distinct().collect())
    if changed:
        rows = merged.where(F.col("bucket").isin(changed)).drop("action").repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return merged.where("action <> 'kept'").select(*keys, "action")


def sweep(base: str, candidates: DataFrame, key: str, version: str, order: list[Column], most: int | None, work: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """One sweep over the candidates that the ledger lacks at ``version``, the first ``most`` or all (None): the ledger rows that it wrote.

    ``work(due)`` gives facts by key. Facts are written under the sweep's number, and after
    them its ledger rows, one for each item, with the number of its facts; ``force`` takes
    items that the ledger has too. The ledger makes a sweep count: one that fails in between
    has no ledger rows, its number is taken again, and what it wrote is written over.
    """
    spark = candidates.sparkSession
    ledger = read(spark, f"{base}/ledger")
    number = 1 if ledger is None else (ledger.agg(F.max("sweep")).first()[0] or 0) + 1
    due = candidates
    if ledger is not None and not force:
        due = due.join(ledger.where(F.col("version") == version).select(key), key, "left_anti")
    due = stored(due if most is None else due.orderBy(*order).limit(most), "due")
    work(due).write.mode("overwrite").parquet(f"{base}/facts/sweep={number}")
    facts = spark.read.parquet(f"{base}/facts/sweep={number}").groupBy(key).agg(F.count("*").alias("facts"))
    done = due.select(key).distinct().join(facts, key, "left").select(key, F.lit(version).alias("version"), F.coalesce("facts", F.lit(0)).alias("facts"))
    done.write.mode("overwrite").parquet(f"{base}/ledger/sweep={number}")
    return spark.read.parquet(f"{base}/ledger/sweep={number}").withColumn("sweep", F.lit(number))


def swept(spark: SparkSession, base: str, key: str) -> DataFrame:
    """The facts of finished sweeps; of an item that several swept, those of the last."""
    facts, ledger = read(spark, f"{base}/facts"), read(spark, f"{base}/ledger")
    last = ledger.groupBy(key).agg(F.max("sweep").alias("sweep"))
    return facts.join(last, [key, "sweep"])
