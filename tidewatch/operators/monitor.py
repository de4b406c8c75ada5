"""Source health, activity windows, overrides, overlap, gazetteers and dimension upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import text as T
from tidewatch.operators.terms import BROADCAST, find_terms
from tidewatch.session import local_rows, stored


def source_states(sources: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """Configured sources (source_id, enabled, interval_ms) with flags, the kind of their next poll and their display tier.

    ``states``: last_success_at, consecutive_failures, next_eligible_at by source_id. A
    disabled source is never flagged. tier: failing 0, others 1, disabled 2.
    """
    at = F.lit(now).cast("timestamp_ntz")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    since = ms(at) - ms(F.col("last_success_at"))
    on, fails = F.col("enabled"), F.coalesce("consecutive_failures", F.lit(0))
    stale = F.coalesce(since > F.col("interval_ms"), F.lit(True))
    backoff = (fails > 0) & F.coalesce(F.col("next_eligible_at") > at, F.lit(False))
    failing = (fails > 0) | stale
    kind = F.when(~on, "skipped").when(backoff, "backoff").when(F.coalesce(since < F.col("interval_ms"), F.lit(False)), "not-due").otherwise("due")
    known = states.withColumn("ever_polled", F.lit(True))
    return sources.join(known, "source_id", "left").select(
        *sources.columns, F.coalesce("ever_polled", F.lit(False)).alias("ever_polled"), (on & stale).alias("stale"), (on & failing).alias("failing"), (on & backoff).alias("in_backoff"),
        kind.alias("kind"), F.when(on & failing, 0).when(~on, 2).otherwise(1).alias("tier"),
    )


def health_summary(states: DataFrame) -> DataFrame:
    n = F.count_if
    return states.agg(F.count("*").alias("configured"), n("enabled").alias("enabled"), n(~F.col("ever_polled")).alias("never_polled"), n("stale").alias("stale"), n("failing").alias("failing"), n("in_backoff").alias("in_backoff"))


WEEK_US = 7 * 86_400_000_000


def anchored_yield(successes: DataFrame) -> DataFrame:
    """(source_id, window_started_at, yielded): a 7-day counter that starts at the first success and anew at the first success 7 days or more after its start.

    ``successes``: source_id, ts, items. Rows stream by source in time order; of each
    source a task keeps one start and one sum.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # (source, start, items)
        done: list[tuple] = []
        for pdf in batches:
            source, at, items = pdf["source_id"].to_numpy(), pdf["us"].to_numpy(np.int64), pdf["items"].to_numpy(np.int64)
            edges = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(pdf) else []
            for lo, hi in zip(edges, [*edges[1:], len(pdf)]):
                if held and held[0] != source[lo]:
                    done.append(held)
                    held = None
                start, total = (held[1], held[2]) if held else (at[lo], 0)
                i = lo
                while i < hi:
                    if at[i] >= start + WEEK_US:
                        start, total = at[i], 0
                    j = lo + int(np.searchsorted(at[lo:hi], start + WEEK_US))
                    total += int(items[i:j].sum())
                    i = j
                held = (source[lo], start, total)
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=["source_id", "us", "yielded"])
                done = []
        if held:
            done.append(held)
        if done:
            yield pd.DataFrame(done, columns=["source_id", "us", "yielded"])

    rows = successes.select("source_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("items").cast("long").alias("items"))
    rows = rows.repartition("source_id").sortWithinPartitions("source_id", "us")
    kind = successes.schema["source_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"source_id {kind}, us long, yielded long")
    return out.select("source_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("window_started_at"), "yielded")


def first_number(v: Column, paths: list[str]) -> Column:
    """The first of the dotted paths (digits index arrays) that leads to a finite number; strings are no numbers."""

    def at(path: str) -> Column:
        steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
        found = F.try_variant_get(v, f"${steps}", "variant")
        number = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        value = F.when(number, F.try_variant_get(v, f"${steps}", "double"))
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    return F.coalesce(*map(at, paths))


def overrides(items: DataFrame, rules: list[dict], profile: str, now: str) -> DataFrame:
    """Items (item_id, source_id, published_at, raw_json) that rules pin for a profile: rule ids by priority and id, least priority.

    A rule has id, priority, source_id, applies_to, enabled, recency_bound_days and either
    nothing more or json_paths, comparator (gte or gt) and threshold. Undated items meet none.
    """
    v, at = F.try_parse_json("raw_json"), F.lit(now).cast("timestamp")
    found = []
    for r in rules:
        if not r["enabled"] or profile not in r["applies_to"]:
            continue
        ok = (F.col("source_id") == r["source_id"]) & D.within_days(F.col("published_at").cast("timestamp"), at, r["recency_bound_days"])
        if "json_paths" in r:
            n = first_number(v, r["json_paths"])
            ok = ok & F.coalesce(n >= r["threshold"] if r["comparator"] == "gte" else n > r["threshold"], F.lit(False))
        found.append(F.when(ok, F.struct(F.lit(r["priority"]).alias("priority"), F.lit(r["id"]).alias("id"))))
    met = F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<struct<priority: int, id: string>>")
    rows = items.withColumn("_m", met).where(F.size("_m") > 0)
    return rows.select("item_id", F.array_join("_m.id", ",").alias("rules"), F.array_min("_m.priority").alias("priority"))


def discussion_overlap(repos: DataFrame, stories: DataFrame, least_slug: int = 6, generic: tuple[str, ...] = (), url_strength: float = 1.0, title_strength: float = 0.6) -> DataFrame:
    """(repo_key, mentions, strength, first_at) of repositories (repo_key, name) that stories (story_key, title, url, fetched_at) mention.

    A story's URL names the repository, or its title holds the name's tokens in a row (not
    short or generic names). URLs are matched by an equi-join on the reference, titles by one
    on whole runs: each title gives its runs of every length that a name has, so that a token
    which many names and titles share pairs nothing by itself. Of each story the earliest
    version that matches counts.
    """
    by_url = stories.withColumn("repo_key", T.code_host_ref(F.col("url"))).where("repo_key is not null").join(repos.select("repo_key"), "repo_key").select("repo_key", "story_key", "fetched_at", F.lit(url_strength).alias("s"))
    tokens = repos.select("repo_key", T.slug_tokens(F.col("name")).alias("run"))
    slug = F.array_join("run", "")
    tokens = tokens.where((F.length(slug) >= least_slug) & ~slug.isin(*generic) if generic else F.length(slug) >= least_slug)
    named = tokens.where(F.size("run") > 0).select("repo_key", F.array_join("run", " ").alias("run"), F.size("run").alias("n"))
    told = stories.select("story_key", "fetched_at", T.slug_tokens(F.col("title")).alias("words"))
    lengths = F.coalesce(named.agg(F.collect_set("n")).scalar(), F.array().cast("array<int>"))
    # no run is longer than its title, and a short title has no run of a long name
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    every = F.flatten(F.transform(F.filter(F.col("lengths"), lambda n: n <= F.size("words")), runs))
    held = told.withColumn("lengths", lengths).select("story_key", "fetched_at", F.explode(F.array_distinct(every)).alias("run"))
    by_title = held.join(named.select("repo_key", "run"), "run").select("repo_key", "story_key", "fetched_at", F.lit(title_strength).alias("s"))
    first = by_url.union(by_title).groupBy("repo_key", "story_key").agg(F.min_by("s", F.struct("fetched_at", -F.col("s"))).alias("s"), F.min("fetched_at").alias("fetched_at"))
    return first.groupBy("repo_key").agg(F.count("*").alias("mentions"), F.max("s").alias("strength"), F.min("fetched_at").alias("first_at"))


SUMMARY_ONLY, OPERATOR_AND_PLACE = 0.85, 0.8


def gazetteer(texts: DataFrame, aliases: list[tuple], sites: list[tuple], countries: list[tuple]) -> DataFrame:
    """(item_key, kind, place, confidence, evidence): the strongest match of each place and country per text.

    ``texts``: item_key, title, summary. ``aliases``: (site, term, confidence); ``sites``:
    (site, country, city, operator terms); ``countries``: (code, term, confidence). A term in
    the summary alone counts ``SUMMARY_ONLY`` of its confidence; operator and city together,
    the city in the title, count ``OPERATOR_AND_PLACE``; a place implies its country. The
    first of equally strong matches wins. All terms are found in one pass by the term index.
    """
    spark = texts.sparkSession
    rows = texts.select("item_key", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("summary") != "", F.col("summary")).alias("summary"))
    cities = [(site, city, operators) for site, _, city, operators in sites if city and operators]
    terms = [t for _, t, _ in aliases + countries] + [c for _, c, _ in cities] + [o for *_, ops in cities for o in ops]
    found = stored(find_terms(rows, "item_key", ["title", "summary"], [(t, False) for t in terms]), "found")
    of = lambda rows, schema: F.broadcast(local_rows(spark, rows, schema)) if len(rows) <= BROADCAST else local_rows(spark, rows, schema)
    base = F.when(F.col("in_title"), F.col("c")).when(F.col("in_summary"), F.col("c") * SUMMARY_ONLY)
    named = lambda names: found.join(of([(*x[:2], float(x[2]), n) for n, x in enumerate(names)], "place string, term string, c double, n int"), "term").select("item_key", "place", base.alias("confidence"), "n").where("confidence IS NOT NULL")
    placed = named(aliases).withColumn("evidence", F.lit("site_alias"))
    if cities:
        n0 = len(aliases)
        town = found.where("in_title").join(of([(s, c, n0 + n) for n, (s, c, _) in enumerate(cities)], "place string, term string, n int"), "term")
        operator = found.join(of([(s, o) for s, _, ops in cities for o in ops], "place string, term string"), "term").select("item_key", "place").distinct()
        both = town.join(operator, ["item_key", "place"]).select("item_key", "place", F.lit(OPERATOR_AND_PLACE).alias("confidence"), "n", F.lit("operator_and_place").alias("evidence"))
        placed = placed.unionByName(both)
    country_of = of([(s[0], s[1]) for s in sites if s[1]], "place string, country string")
    implied = placed.join(country_of, "place").select("item_key", F.col("country").alias("place"), "confidence", (F.col("n") + len(countries)).alias("n"), F.lit("implied").alias("evidence"))
    told = named(countries).withColumn("evidence", F.lit("country_alias")).unionByName(implied)
    matches = placed.withColumn("kind", F.lit("site")).unionByName(told.withColumn("kind", F.lit("country")))
    return matches.groupBy("item_key", "kind", "place").agg(F.max_by(F.struct("confidence", "evidence"), F.struct("confidence", -F.col("n"))).alias("b")).select("item_key", "kind", "place", "b.confidence", "b.evidence")


def overlaid(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the overlay's replace. Of rows of one key in one table the greatest stays."""
    rest = [c for c in base.columns if c != key]
    both = base.select(key, F.lit(0).alias("_p"), F.struct(*rest).alias("_r")).unionByName(overlay.select(key, F.lit(1).alias("_p"), F.struct(*rest).alias("_r")))
    return both.groupBy(key).agg(F.max_by("_r", F.struct("_p", "_r")).alias("_r")).select(key, "_r.*")


def filled(curated: DataFrame, names: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """``curated`` and, for keys that only ``names`` has, rows of defaults."""
    more = names.join(curated.select(key), key, "left_anti")
    return curated.unionByName(more.select(key, *[defaults.get(c, F.col(c) if c in names.columns else F.lit(None)).cast(curated.schema[c].dataType).alias(c) for c in curated.columns if c != key]))


def scanned(ranked: DataFrame, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The rows of a ranked scan that stops once every list is full.

    ``ranked`` has ``list`` (null for rows on none). The scan ends at the latest row that
    fills a list: only the few rows on the lists are ranked, and one key is compared with all rows.
    """
    from pyspark.sql import Window

    key = F.struct(*order)
    taken = ranked.withColumn("_k", key)
    w = Window.partitionBy("list").orderBy("_k")
    full = F.lit(False)
    for name, most in limits.items():
        full = full | ((F.col("list") == name) & (F.col("_n") == most))
    ends = taken.where(F.col("list").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(limits.values())).where(full)
    last = ends.agg(F.when(F.count("*") == len(limits), F.max("_k")).alias("_end"))
    taken = taken.withColumn("_end", last.scalar())
    return taken.where(F.col("_end").isNull() | (F.col("_k") <= F.col("_end"))).drop("_k", "_end")
