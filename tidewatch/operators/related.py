"""The names that stand most often beside each name, for all names at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stored

#: Names of an item up to which its pairs are listed.
LARGE = 200


def related(mentions: DataFrame, most: int = 15, floor: int = 2, large: int = LARGE) -> DataFrame:
    """(entity, related, weight, place): of every entity the ``most`` others that share most items with it, ties by name.

    ``mentions``: entity, item_key. Entities of fewer than ``floor`` items take no part.
    Pairs of small items are listed and counted. Items of over ``large`` names are never
    paired: names with the same set of large items form a class, classes are compared in
    their place, and of each class the first ``most + 1`` names stand for all. That is
    exact: a name that was not listed shares no small item, so at least ``most`` names of
    its classes' lists are as good, by their own pairs or by the same overlap.
    """
    rows = mentions.select("entity", "item_key").distinct()
    counts = rows.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    rows = stored(rows.join(counts.select("entity"), "entity", "left_semi"), "mentions")
    sizes = rows.groupBy("item_key").agg(F.count("*").alias("n"))
    few = rows.join(sizes.where(F.col("n") <= large).select("item_key"), "item_key")
    listed = few.withColumnRenamed("entity", "a").join(few.withColumnRenamed("entity", "b"), "item_key").where("a <> b")
    listed = listed.groupBy("a", "b").agg(F.count("*").alias("s"))

    many = rows.join(sizes.where(F.col("n") > large).select("item_key"), "item_key")
    sets = many.groupBy("entity").agg(F.array_sort(F.collect_list("item_key")).alias("set"))
    own = stored(sets.withColumn("nth", F.row_number().over(Window.partitionBy("set").orderBy("entity"))), "classes")
    heads = own.where("nth = 1").select(F.col("entity").alias("c"), "set")
    member = own.join(heads, "set").select("entity", "c")
    firsts = own.where(F.col("nth") <= most + 1).join(heads, "set").select(F.col("c").alias("d"), F.col("entity").alias("b"))
    held = heads.select("c", F.explode("set").alias("item"))
    overlap = held.join(held.withColumnRenamed("c", "d"), "item").groupBy("c", "d").agg(F.count("*").alias("o"))
    best = Window.partitionBy("c").orderBy(F.desc("o"), "b")
    tops = overlap.join(firsts, "d").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most + 1).select("c", "b", "o")
    by_class = member.withColumnRenamed("entity", "a").join(tops, "c").where("a <> b").select("a", "b", F.col("o").alias("weight"))

    of_a, of_b = member.toDF("a", "c"), member.toDF("b", "d")
    by_pair = listed.join(of_a, "a", "left").join(of_b, "b", "left").join(overlap, ["c", "d"], "left").select("a", "b", (F.col("s") + F.coalesce("o", F.lit(0))).alias("weight"))
    both = by_pair.unionByName(by_class).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    place = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    ranked = both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return ranked.select(F.col("a").alias("entity"), F.col("b").alias("related"), "weight", "place")
