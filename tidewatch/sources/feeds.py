"""Feed documents and payload envelopes as entry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_entries(df: DataFrame, body: str, field: str, schema: str) -> DataFrame:
    """Explodes the array ``field`` of a JSON envelope; an envelope that does not parse gives no entry."""
    parsed = F.from_json(body, f"{field} array<{schema}>")
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.explode(parsed[field]).alias("entry")).select(*rest, "entry.*")


def xml_entries(df: DataFrame, body: str, schema: str) -> DataFrame:
    """One entry per XML document of the column ``body``."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.from_xml(body, schema, {"mode": "PERMISSIVE"}).alias("entry")).select(*rest, "entry.*")


def accepted(*mandatory: Column) -> Column:
    """Entries whose mandatory fields are there and not blank."""
    ok = F.lit(True)
    for c in mandatory:
        ok = ok & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    return ok


def cap_recent(df: DataFrame, source: str, recency: Column, most: int) -> DataFrame:
    """At most ``most`` newest rows per source, undated last."""
    w = Window.partitionBy(source).orderBy(recency.desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def languages(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows of an allowed language; unknown languages are kept."""
    return df.where(F.col(column).isNull() | F.col(column).isin(*allowed))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def search_union(pages: DataFrame) -> DataFrame:
    """Rows of all result pages of a topic, each id once: its first by (request, page, position).

    ``pages``: topic, request, page, items array<struct<id, fork, archived, ...>>.
    """
    rows = pages.select("topic", "request", "page", F.posexplode("items").alias("pos", "item"))
    first = rows.groupBy("topic", F.col("item.id").alias("id")).agg(F.min_by("item", F.struct("request", "page", "pos")).alias("_i"), F.min("request").alias("request"))
    return first.select("topic", "request", "_i.*")


def search_coverage(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per topic: pages planned and completed, rows reported and retrieved, repeats, forks or archived, kept.

    ``plan``: topic, request, planned, reported.
    """
    asked = plan.groupBy("topic").agg(F.sum("planned").alias("planned"), F.sum("reported").alias("reported"))
    got = pages.groupBy("topic").agg(F.count("*").alias("completed"), F.sum(F.size("items")).alias("retrieved"))
    unlike = F.col("fork") | F.col("archived")
    kept = search_union(pages).groupBy("topic").agg(F.count("*").alias("ids"), F.count_if(unlike).alias("filtered"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    both = asked.join(got, "topic", "left").join(kept, "topic", "left")
    return both.select("topic", *[zero(c).alias(c) for c in ("planned", "completed", "reported", "retrieved")], (zero("retrieved") - zero("ids")).alias("repeated"), zero("filtered").alias("filtered"), (zero("ids") - zero("filtered")).alias("kept"))
