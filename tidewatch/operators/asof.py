"""The run in force at each of many instants, by a merge of sorted times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_force(instants: DataFrame, at: str, runs: DataFrame, run: str, period: str = "day", salts: int = 8) -> DataFrame:
    """``instants`` with ``run``: the last of ``runs`` that is not after ``at``, null where there is none (or ``at`` is null).

    Times are parted by ``period``. In each part the instants and the part's runs are merged
    in order, with the instants dealt to ``salts`` and the runs copied to each, so no task
    has a busy period alone. An instant before its part's first run takes the last run of
    the parts before, carried over a list of one row a part. No side is broadcast.
    """
    runs = runs.select(F.col(run)).where(F.col(run).isNotNull()).distinct()
    part = lambda c: F.date_trunc(period, c).alias("_part")
    key = F.struct(*instants.columns)
    asked = instants.select(key.alias("_row"), F.col(at).alias("_at"), part(F.col(at)), F.pmod(F.xxhash64(*instants.columns), F.lit(salts)).cast("long").alias("_salt"), F.lit(None).cast(runs.schema[run].dataType).alias("_run"), F.lit(1).alias("_side"))
    given = runs.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(run).cast(asked.schema["_at"].dataType).alias("_at"), part(F.col(run)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"), F.col(run).alias("_run"), F.lit(0).alias("_side"))
    inside = Window.partitionBy("_part", "_salt").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = asked.unionByName(given).withColumn("_own", F.last("_run", ignorenulls=True).over(inside)).where("_side = 1")
    # one row a part, of runs and of instants, so that parts without runs get what is carried
    last = runs.groupBy(part(F.col(run))).agg(F.max(run).alias("_last")).unionByName(asked.select("_part").distinct().withColumn("_last", F.lit(None).cast(runs.schema[run].dataType)))
    last = last.groupBy("_part").agg(F.max("_last").alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_before"))
    return merged.join(carried, "_part", "left").select("_row.*", found.alias(run))
