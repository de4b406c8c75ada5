"""Full-text search over a stored index of word positions.

Two tables under one folder. ``postings`` has a row for each word, item and field, with the
places of the word there; it is parted by a hash of the word and sorted by word, so a query
reads the parts of its words alone. ``items`` has each item's current version, its texts and
its number of words. A posting carries the version that it was made of: a revision adds
postings of its own, and those of older versions no longer meet the item. ``compact`` drops them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidewatch.operators.tables import read, upsert_into
from tidewatch.operators.versions import newest
from tidewatch.session import local_rows, stored

BUCKETS = 32
#: The ranking's parameters (fixed values), and the words of a snippet.
K1, B, SNIPPET = 1.2, 0.75, 12
WORD, OTHER = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def words(text: Column) -> Column:
    """The lower-case words of a text in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{OTHER}+"), lambda w: w != "")


@F.pandas_udf(ArrayType(StructType([StructField("word", StringType()), StructField("at", ArrayType(IntegerType()))])))
def gathered(words: pd.Series) -> pd.Series:
    """Each distinct word of a text with its places in order."""

    def one(text) -> list[dict]:
        at: dict[str, list[int]] = {}
        for i, w in enumerate(text):
            at.setdefault(w, []).append(i)
        return [{"word": w, "at": places} for w, places in at.items()]

    return words.map(one)


def phrases(query: str) -> list[list[str]]:
    """What white space parts in a query, each as the words that must stand in a row; none for a blank query."""
    found = [[w for w in re.split(r"[\W_]+", p.lower()) if w] for p in query.split()]
    return [p for p in found if p]


class SearchIndex:
    """An index of items (item_key, fetched_at, ingest_seq and the text ``fields``) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.fields, self.buckets = spark, path, fields, buckets

    def upsert(self, versions: DataFrame) -> DataFrame:
        """Takes versions in: newer ones replace what the index has of their items, older ones are ignored. (item_key, action) of each."""
        place = F.struct("fetched_at", "ingest_seq").alias("place")
        size = sum((F.size(words(F.col(f))) for f in self.fields), F.lit(0)).cast("long").alias("n")
        rows = stored(newest(versions.select("item_key", place, *self.fields), ["item_key"], "place"), "search-new").select("item_key", "place", *self.fields, size)
        # postings first: without the item's row of this version they are met by nothing
        # a word's places in a text are gathered where the text is, so that only postings move
        texts = F.array(*[words(F.col(f)) for f in self.fields])
        made = rows.select("item_key", "place", F.posexplode(texts).alias("field", "words")).select("item_key", "place", "field", F.inline(gathered("words")))
        made = made.withColumn("bucket", F.pmod(F.hash("word"), F.lit(self.buckets)))
        made.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        return upsert_into(f"{self.path}/items", rows, ["item_key"], "place", self.buckets, single=True)

    def compact(self) -> None:
        """Writes the postings of current versions alone, each once, part by part."""
        items = read(self.spark, f"{self.path}/items").select("item_key", "place")
        held = self.spark.read.parquet(f"{self.path}/postings")
        rows = stored(held.join(items, ["item_key", "place"]).select(*held.columns).dropDuplicates(["bucket", "word", "item_key", "field"]), "compact")
        rows.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")

    def _hits(self, wanted: list[list[str]]) -> DataFrame:
        """(phrase, item_key, field, tf, first) of every phrase in current versions."""
        parts = sorted({self._bucket(w) for p in wanted for w in p})
        held = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(parts) & F.col("word").isin(sorted({w for p in wanted for w in p})))
        asked = local_rows(self.spark, [(i, n, w, len(p)) for i, p in enumerate(wanted) for n, w in enumerate(p)], "phrase int, nth int, word string, many int")
        met = held.join(F.broadcast(asked), "word").dropDuplicates(["phrase", "nth", "item_key", "place", "field"])
        if all(len(p) == 1 for p in wanted):
            return met.select("phrase", "item_key", "place", "field", F.size("at").alias("tf"), F.array_min("at").alias("first"))
        starts = met.select("phrase", "many", "item_key", "place", "field", F.explode(F.transform("at", lambda a: a - F.col("nth"))).alias("start"))
        runs = starts.groupBy("phrase", "many", "item_key", "place", "field", "start").agg(F.count("*").alias("k")).where("k = many")
        return runs.groupBy("phrase", "item_key", "place", "field").agg(F.count("*").alias("tf"), F.min("start").alias("first"))

    def _bucket(self, word: str) -> int:
        if not hasattr(self, "_known"):
            self._known: dict[str, int] = {}
        if word not in self._known:
            self._known[word] = local_rows(self.spark, [(word,)], "w string").select(F.pmod(F.hash("w"), F.lit(self.buckets))).first()[0]
        return self._known[word]

    def search(self, query: str, most: int = 50, weights: list[float] | None = None) -> DataFrame | None:
        """(item_key, rank, snippet): items that hold every phrase of the query, best first; None for a blank query, which is no search.

        ``weights`` count a hit in each field; the snippet is of the field and place of the
        query's first phrase, its first words in brackets.
        """
        wanted = phrases(query)
        if not wanted:
            return None
        weight = F.array(*[F.lit(float(w)) for w in (weights or [1.0] * len(self.fields))])
        items = self.spark.read.parquet(f"{self.path}/items")
        told = items.where("n > 0")  # items without a word count for nothing
        sizes = {"docs": told.agg(F.count("*")).scalar(), "mean": told.agg(F.avg("n")).scalar()}
        hits = self._hits(wanted).join(items.select("item_key", "place", "n"), ["item_key", "place"])
        each = hits.groupBy("phrase", "item_key", "n").agg(F.sum(F.col("tf") * F.get(weight, F.col("field"))).alias("tf"), F.min(F.struct("field", "first")).alias("at"))
        each = stored(each, "hits")
        df = each.groupBy("phrase").agg(F.count("*").alias("df")).withColumns(sizes)  # one row a phrase
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        ranked = each.join(F.broadcast(df), "phrase").groupBy("item_key").agg(F.round(F.sum(gain), 6).alias("rank"), F.count("*").alias("k"), F.min_by("at", "phrase").alias("at"))
        top = ranked.where(F.col("k") == len(wanted)).orderBy(F.desc("rank"), "item_key").limit(most)
        text = F.get(F.array(*self.fields), F.col("at.field"))
        shown = items.join(F.broadcast(top), "item_key").select("item_key", "rank", self._snippet(text, F.col("at.first"), len(wanted[0])).alias("snippet"))
        return shown.orderBy(F.desc("rank"), "item_key")

    @staticmethod
    def _snippet(text: Column, first: Column, many: int) -> Column:
        """Words about the one at ``first``, as they stand in the text, the found ones in brackets."""
        pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{WORD}+{OTHER}*"), F.lit(0))
        begin = F.greatest(first - SNIPPET // 2, F.lit(0))
        near = F.slice(pieces, (begin + 1).cast("int"), F.lit(SNIPPET))
        marked = F.transform(near, lambda p, i: F.when((i + begin >= first) & (i + begin < first + many), F.regexp_replace(p, f"^({WORD}+)", "[$1]")).otherwise(p))
        return F.trim(F.regexp_replace(F.array_join(marked, ""), r"\s+", " "))
