"""Near-duplicate clusters of titles across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import shingles, title_tokens
from tidewatch.operators.graph import connected_components


def shingled(items: DataFrame) -> DataFrame:
    """(item_key, source, shingle) of items with a title."""
    return items.select("item_key", "source", F.explode(shingles(title_tokens(F.col("title")))).alias("shingle"))


def rare(rows: DataFrame, most: int = 5) -> DataFrame:
    """Shingles of at most ``most`` items: each posting list is bounded, so a pair join cannot blow up."""
    df = rows.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return rows.join(df.select("shingle"), "shingle")


def pairs(rows: DataFrame, least: float = 0.10) -> DataFrame:
    """(a, b, score): pairs of different sources whose rare shingles have a Jaccard similarity of ``least``."""
    r = rare(rows)
    sizes = r.groupBy("item_key").agg(F.count("*").alias("n"))
    left = r.select(F.col("item_key").alias("a"), F.col("source").alias("sa"), "shingle")
    right = r.select(F.col("item_key").alias("b"), F.col("source").alias("sb"), "shingle")
    both = left.join(right, "shingle").where("a < b and sa <> sb").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.withColumn("score", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6)).where(F.col("score") >= least).select("a", "b", "score")


def clusters(edges: DataFrame) -> DataFrame:
    """(item_key, cluster_id, size): connected pairs; the id is the smallest key."""
    member = connected_components(edges, "a", "b").toDF("item_key", "cluster_id")
    return member.join(member.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id").select("item_key", "cluster_id", "size")
