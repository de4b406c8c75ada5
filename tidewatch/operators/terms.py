"""Many terms in many texts: a multi-pattern index over dictionary rows.

A term is a sequence of words that stand in a row, parted by white space or hyphens alone, and
not inside a longer word. Texts and terms become sequences of words, with a mark for whatever
else stands between two words. Each term is entered under one of its words, the one that fewest
terms hold (of those the longest); the words of the texts are joined to it, each with its
place, and the words around the places that met are compared with the term's. So a text meets
only terms whose word it holds, and the cost is one pass over the texts however many terms
there are.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import local_rows, spread

#: Terms of a dictionary that are broadcast; longer ones are joined by a shuffle.
BROADCAST = 200_000
#: Words that a text's words are compared with before they are joined; more are only joined.
LISTED = 1_000
#: Stands between words that something else than white space or hyphens parts.
MARK = "\x01"
APART = r"[^\p{L}\p{N}_\s-]+"


def spaced(text: Column) -> Column:
    """The words of a text in order, parted by one space, with marks where they don't follow each other directly; empty for null."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), APART, f" {MARK} ")
    return F.trim(F.regexp_replace(marked, r"[\s-]+", " "))


def parted(form: Column) -> Column:
    """The words of a spaced form."""
    return F.when(form != "", F.split(form, " ")).otherwise(F.array().cast("array<string>"))


def words_of(term: str) -> list[str]:
    return [w for w in re.split(r"[\s-]+", re.sub(r"[^\w\s-]+", f" {MARK} ", term)) if w]


def find_terms(texts: DataFrame, key: str, fields: list[str], terms: list[tuple[str, bool]]) -> DataFrame:
    """(key, term, exact, ``in_<field>`` of each field): terms that a field holds, or the fields one behind the other do.

    ``terms``: (term, exact); exact ones match in their own case only. Null fields hold
    nothing, and a term without a word holds nowhere. A term with marks between or beside its
    words is looked up by its words, then checked against its own pattern.
    """
    spark = texts.sparkSession
    known = sorted({(t, x): words_of(t) for t, x in terms}.items())
    whole = [(t, x, w if x else [a.lower() for a in w]) for (t, x), w in known if w and MARK not in w]
    odd = [(t, x, [a.lower() for a in w if a != MARK]) for (t, x), w in known if MARK in w and w != [MARK]]
    small = F.broadcast if len(known) <= BROADCAST else (lambda df: df)
    held = spread(texts.select(key, *fields))
    found = _runs(held, key, fields, whole, small)
    if odd:
        found = found.unionByName(_patterns(held, key, fields, odd, small))
    return found


def _entered(terms: list[tuple[str, bool, list[str]]]) -> list[tuple]:
    """(term, exact, run, token, at): each term under the word that fewest terms hold, then the longest, and the place of it in the run.

    Which word that is changes no result; to count words in the texts would take a pass of its own.
    """
    held = Counter(a for *_, w in terms for a in {x.lower() for x in w})
    rows = []
    for t, x, w in terms:
        token, at = min(((a.lower(), i) for i, a in enumerate(w)), key=lambda c: (held[c[0]], -len(c[0]), c))
        rows.append((t, x, w, token, at))
    return rows


def _table(spark, entered: list[tuple]) -> DataFrame:
    return local_rows(spark, entered, "term string, exact boolean, run array<string>, token string, at int")


def _runs(held: DataFrame, key: str, fields: list[str], terms: list[tuple[str, bool, list[str]]], small) -> DataFrame:
    spark = held.sparkSession
    rows = held.select(key, *[spaced(F.col(f)).alias(f"_{f}") for f in fields])
    # where each field ends in the words of all fields
    count = lambda f: F.size(parted(F.col(f"_{f}")))
    ends = [sum((count(g) for g in fields[: i + 1]), F.lit(0)).alias(f"_end_{f}") for i, f in enumerate(fields)]
    whole = F.concat_ws(" ", *[F.when(F.col(f"_{f}") != "", F.col(f"_{f}")) for f in fields])
    rows = rows.select(key, whole.alias("form"), *ends)
    entered = _entered(terms)
    # a word takes along the words around it, and never its whole text
    most = max((len(w) for *_, w in terms), default=0)
    rows = rows.select(key, parted(F.col("form")).alias("seq"), parted(F.lower("form")).alias("low"), *[f"_end_{f}" for f in fields])
    begin = lambda place: F.greatest(place - most, F.lit(0))
    around = lambda i: F.struct(i.alias("place"), F.get("low", i).alias("token"), F.slice("seq", begin(i) + 1, F.lit(2 * most + 1)).alias("around"))
    places = F.sequence(F.lit(0), F.size("seq") - 1)
    tokens = sorted({token for *_, token, _ in entered})
    if len(tokens) <= LISTED:
        # words that meet no term go before anything is made of them
        places = F.filter(places, lambda i: F.get("low", i).isin(tokens))
    each = F.when(F.size("seq") > 0, F.transform(places, around))
    placed = rows.select(key, *[f"_end_{f}" for f in fields], F.inline(each))
    met = placed.join(small(_table(spark, entered)), "token").withColumn("start", F.col("place") - F.col("at")).withColumn("base", begin(F.col("place")))
    own = F.slice("around", F.col("start") - F.col("base") + 1, F.size("run"))
    same = F.when(F.size("run") == 1, ~F.col("exact") | (F.get(F.col("around"), F.col("place") - F.col("base")) == F.get("run", F.lit(0)))).otherwise(F.when(F.col("exact"), own).otherwise(F.transform(own, F.lower)) == F.col("run"))
    met = met.where((F.col("start") >= F.col("base")) & same)
    flags, begins = [], [F.lit(0), *[F.col(f"_end_{f}") for f in fields[:-1]]]
    for f, begin in zip(fields, begins):
        flags.append(F.max((F.col("start") >= begin) & (F.col("start") + F.size("run") <= F.col(f"_end_{f}"))).alias(f"in_{f}"))
    return met.groupBy(key, "term", "exact").agg(*flags)


def _patterns(held: DataFrame, key: str, fields: list[str], terms: list[tuple[str, bool, list[str]]], small) -> DataFrame:
    spark = held.sparkSession
    every = F.concat_ws(" ", *fields)
    tokens = held.select("*", F.explode(F.array_distinct(parted(F.lower(spaced(every))))).alias("token"))
    entered = _table(spark, _entered(terms)).select("term", "exact", "token")
    escaped = F.regexp_replace("term", r"[^\p{L}\p{N}_\s-]", r"\\$0")
    body = F.regexp_replace(F.regexp_replace(escaped, r"^[\s-]+|[\s-]+$", ""), r"[\s-]+", r"[\\s-]+")
    pattern = F.concat(F.when(F.col("exact"), "").otherwise("(?iu)"), F.lit(r"(?<![\p{L}\p{N}_])"), body, F.lit(r"(?![\p{L}\p{N}_])"))
    met = tokens.join(small(entered), "token").where(F.rlike(every, pattern))
    return met.select(key, "term", "exact", *[F.coalesce(F.rlike(F.col(f), pattern), F.lit(False)).alias(f"in_{f}") for f in fields])
