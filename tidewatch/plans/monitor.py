"""Health, activity, overrides, overlap, places, weekly lists, feeds and usage in full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions.names import novel_words
from tidewatch.operators import feed as FD
from tidewatch.operators import monitor as M
from tidewatch.operators import tables
from tidewatch.operators import versions as V
from tidewatch.operators.passes import as_row, counted_write
from tidewatch.plans import NOW, query
from tidewatch.plans.operations import SOURCE_SQL, attempts, stream
from tidewatch.plans.ranking import BEST_SQL, best
from tidewatch.plans.text import cluster_runs
from tidewatch.plans.versions import STATE_SQL, state_log, versions
from tidewatch.session import local_rows, scratch, stored, table
from tidewatch.streaming import keyed
from tidewatch.streaming import state as S

HEALTH_SQL = f"""WITH st AS ({SOURCE_SQL}),
    c AS (SELECT c_custkey AS source_id, c_custkey % 10 <> 0 AS enabled, (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 24 ELSE 72 END * 3600000)::BIGINT AS interval_ms FROM customer),
    j AS (SELECT c.*, st.source_id IS NOT NULL AS ever_polled, coalesce(consecutive_failures, 0) AS n, next_eligible_at AS nx, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(last_success_at) AS since FROM c LEFT JOIN st ON c.source_id = st.source_id),
    f AS (SELECT *, since IS NULL OR since > interval_ms AS rs, n > 0 AND nx > TIMESTAMP '{NOW}' AS rb FROM j),
    h AS (SELECT source_id, enabled, interval_ms, ever_polled, enabled AND rs AS stale, enabled AND (rs OR n > 0) AS failing, enabled AND rb AS in_backoff,
          CASE WHEN NOT enabled THEN 'skipped' WHEN rb THEN 'backoff' WHEN since < interval_ms THEN 'not-due' ELSE 'due' END AS kind, CASE WHEN enabled AND (rs OR n > 0) THEN 0 WHEN NOT enabled THEN 2 ELSE 1 END AS tier FROM f)"""


def health(spark, d):
    k = F.col("c_custkey")
    sources = table(spark, d, "customer").select(k.alias("source_id"), (k % 10 != 0).alias("enabled"), D.duration_ms(F.when(k % 3 == 0, "60m").when(k % 3 == 1, "24h").otherwise("3d")).alias("interval_ms"))
    return M.source_states(sources, S.replay_sources(attempts(table(spark, d, "events"))), NOW)


@query(HEALTH_SQL + " SELECT * FROM h")
def source_states(spark, d):
    """Every configured source, failing ones first, disabled ones last, else as configured."""
    return health(spark, d).orderBy("tier", "source_id")


@query(HEALTH_SQL + " SELECT count(*) AS configured, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT ever_polled) AS never_polled, count(*) FILTER (stale) AS stale, count(*) FILTER (failing) AS failing, count(*) FILTER (in_backoff) AS in_backoff FROM h")
def source_health_summary(spark, d):
    return M.health_summary(health(spark, d))


ANCHORED_SQL = """WITH RECURSIVE l AS (SELECT user_id AS s, ts, event_id % 5 AS n FROM events WHERE event_type <> 'error'), w AS (SELECT s, min(ts) AS st FROM l GROUP BY s UNION ALL SELECT w.s, min(l.ts) FROM w JOIN l ON l.s = w.s AND l.ts >= w.st + INTERVAL 7 DAY GROUP BY w.s, w.st),
    f AS (SELECT s, max(st) AS st FROM w GROUP BY s) SELECT f.s AS source_id, st AS window_started_at, sum(n)::BIGINT AS yielded FROM f JOIN l ON l.s = f.s AND l.ts >= f.st GROUP BY ALL"""


@query(ANCHORED_SQL)
def anchored_yields(spark, d):
    return M.anchored_yield(table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("source_id"), "ts", (F.col("event_id") % 5).alias("items")))


@query(ANCHORED_SQL)
def stream_anchored_yields(spark, d):
    """The same counters from the stream of events; rows may come 31 days late, and files in any order."""
    ok = stream(spark, d).where("event_type <> 'error'").select(F.col("user_id").alias("source_id"), "ts", (F.col("event_id") % 5).alias("items"))
    last, _ = keyed.last_rows(keyed.anchored_counts(ok, "31 days"), "source_id")
    return last.select("source_id", F.timestamp_micros("window_us").cast("timestamp_ntz").alias("window_started_at"), "yielded")


@query(f"SELECT user_id AS place, count(*) AS items, max(ts) AS latest FROM events WHERE value >= 20 AND ts > TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def place_activity(spark, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    recent = (F.col("ts") > now - F.expr("interval 168 hours")) & (F.col("ts") <= now)
    return table(spark, d, "events").where(recent & (F.col("value") >= 20)).groupBy(F.col("user_id").alias("place")).agg(F.count("*").alias("items"), F.max("ts").alias("latest"))


@query("""WITH x AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_brand || '-' || p_size ELSE 'CVE-2024-' || (1000 + p_partkey) END AS entity FROM part) SELECT entity FROM x WHERE NOT regexp_matches(entity, '^CVE-[0-9]{4}-[0-9]{4,10}$')
          AND entity NOT IN (SELECT p_brand || '-' || p_size FROM part WHERE p_size % 3 <> 0) ORDER BY entity LIMIT 50""")
def orphaned_entities(spark, d):
    """Extracted names that neither the dictionary nor an enabled pattern gives any more; a report of 50."""
    p = table(spark, d, "part")
    name = F.concat("p_brand", F.lit("-"), "p_size")
    got = p.select(F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.concat(F.lit("CVE-2024-"), 1000 + F.col("p_partkey"))).alias("entity")).distinct()
    known = p.where("p_size % 3 <> 0").select(name.alias("entity")).distinct()
    return got.where(~F.col("entity").rlike(r"(?i)^CVE-\d{4}-\d{4,10}$")).join(known, "entity", "left_anti").orderBy("entity").limit(50)


@query("""WITH b AS (SELECT c_custkey, c_nationkey, count(DISTINCT o_orderpriority) AS beats FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
          SELECT count(*) AS considered, count(*) FILTER (beats > 0 AND c_nationkey % 10 <> 0) AS scored, count(*) FILTER (beats = 0) AS skipped, coalesce(sum(beats) FILTER (beats > 0 AND c_nationkey % 10 <> 0), 0)::BIGINT AS rows_written, count(*) FILTER (beats > 0 AND c_nationkey % 10 = 0) AS failures FROM b""")
def scoring_pass(spark, d):
    """Outcome counts of a pass: items without a beat are skipped, items of unknown sources fail alone."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderpriority").alias("beats"))
    b = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left").withColumn("beats", F.coalesce("beats", F.lit(0)))
    bare, unknown = F.col("beats") == 0, F.col("c_nationkey") % 10 == 0
    good = ~bare & ~unknown
    counts = {"considered": F.count("*"), "scored": F.count_if(good), "skipped": F.count_if(bare), "rows_written": F.sum(F.when(good, F.col("beats"))), "failures": F.count_if(~bare & unknown)}
    return as_row(b, counted_write(b, scratch(spark, "scored"), good, counts))


@query("""WITH b AS (SELECT c_custkey, count(DISTINCT o_orderpriority) AS beats FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), n AS (SELECT count(*) AS all_, count(*) FILTER (c_custkey % 2 = 0) AS half, sum(beats) AS f, sum(beats) FILTER (c_custkey % 2 = 0) AS g FROM b)
          SELECT unnest([1, 2, 3, 4]) AS sweep, unnest(['v1', 'v1', 'v2', 'v2']) AS version, unnest([half, all_ - half, all_, all_]) AS items, unnest([g, f - g, f, f])::BIGINT AS facts FROM n""")
def scoring_sweeps(spark, d):
    """Scores written by passes that take only items whose scores lack the version: the rest after a first half, all at a new version, all again by force."""
    base, beats = scratch(spark, "scoring"), table(spark, d, "orders").select(F.col("o_custkey").alias("item_key"), F.col("o_orderpriority").alias("beat")).distinct()
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_key"))
    scored = lambda due: due.join(beats, "item_key").select("item_key", "beat", F.round(F.sqrt("item_key"), 6).alias("score"))
    done = None
    for due, version, force in ((items.where("item_key % 2 = 0"), "v1", False), (items, "v1", False), (items, "v2", False), (items, "v2", True)):
        rows = tables.sweep(base, due, "item_key", version, [], None, scored, force=force)
        done = rows if done is None else done.unionByName(rows)
    return done.groupBy("sweep", "version").agg(F.count("*").alias("items"), F.sum("facts").alias("facts"))


@query("""WITH b AS (SELECT p_partkey AS site_id, p_brand AS name, p_size AS size FROM part),
          u AS (SELECT *, 0 AS file FROM b UNION ALL SELECT site_id, 'overlay', 99, 1 FROM b WHERE site_id % 5 = 0 UNION ALL SELECT 1000000 + s_suppkey, s_name, 1, 1 FROM supplier)
          SELECT site_id, name, size FROM u QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY file DESC, name DESC, size DESC) = 1""")
def overlaid_sites(spark, d):
    """A base of sites and a later file that replaces some and adds others, whatever their keys; of rows of one key in one file the greatest."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("name"), F.col("p_size").alias("size"))
    over = base.where("site_id % 5 = 0").select("site_id", F.lit("overlay").alias("name"), F.lit(99).alias("size"))
    new = table(spark, d, "supplier").select((1000000 + F.col("s_suppkey")).alias("site_id"), F.col("s_name").alias("name"), F.lit(1).alias("size"))
    return M.overlaid(base, over.unionByName(new), "site_id")


@query("SELECT n_nationkey AS code, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'restricted' ELSE 'unknown' END AS export_control, CASE WHEN n_nationkey % 2 = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM nation")
def filled_jurisdictions(spark, d):
    """Curated jurisdictions, and defaults that claim nothing for the other codes."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    curated = names.where("code % 2 = 0").withColumns({"export_control": F.lit("restricted"), "confidence": F.lit(0.9)})
    return M.filled(curated, names, "code", {"export_control": F.lit("unknown"), "confidence": F.lit(0.7)})


ALIASES = [("park", "licensed under", 0.9), ("park", "apache license", 0.95), ("post", "mail", 0.6)]
SITES = [("park", "US", "license", ["apache", "mail"]), ("post", "DE", None, []), ("works", "FR", "the", ["worthless", "mail"])]
COUNTRIES = [("US", "nation", 0.7), ("FR", "de la", 0.7)]


def texts(spark, d):
    """Documents as title (first line) and summary (the rest)."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), F.substring_index("text", "\n", 1).alias("title"), F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1).alias("summary"))


def _sql_gazetteer() -> str:
    hit = lambda text, term: f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])" + r"[\s-]+".join(term.split()) + "($|[^\\p{L}\\p{N}_])')"
    base = lambda term, c: f"CASE WHEN {hit('title', term)} THEN {c} WHEN {hit('summary', term)} THEN {c} * 0.85 END::DOUBLE"
    placed = [(s, base(t, c), "site_alias") for s, t, c in ALIASES]
    placed += [(s, f"CASE WHEN {hit('title', city)} AND ({' OR '.join(hit(chr(40) + 'title || chr(32) || summary' + chr(41), o) for o in ops)}) THEN 0.8 END::DOUBLE", "operator_and_place") for s, _, city, ops in SITES if city and ops]
    of = {s[0]: s[1] for s in SITES}
    rows = [("site", s, c, why, i) for i, (s, c, why) in enumerate(placed)] + [("country", code, base(t, c), "country_alias", i) for i, (code, t, c) in enumerate(COUNTRIES)] + [("country", of[s], c, "implied", len(COUNTRIES) + i) for i, (s, c, _) in enumerate(placed)]
    parts = " UNION ALL ".join(f"SELECT item_key, '{k}' AS kind, '{p}' AS place, {c} AS confidence, '{w}' AS evidence, {n} AS n FROM t" for k, p, c, w, n in rows)
    return f"""t AS (SELECT doc_id AS item_key, split_part(text, chr(10), 1) AS title, regexp_extract(text, '^[^\\n]*\\n(.*)$', 1, 's') AS summary FROM documents WHERE text IS NOT NULL),
        g AS (SELECT * FROM ({parts}) WHERE confidence IS NOT NULL), b AS (SELECT item_key, kind, place, confidence, evidence FROM g QUALIFY row_number() OVER (PARTITION BY item_key, kind, place ORDER BY confidence DESC, n) = 1)"""


@query(f"WITH {_sql_gazetteer()} SELECT item_key, kind, place, round(confidence, 6) AS confidence, evidence FROM b")
def place_matches(spark, d):
    """Strongest matches, by confidence and then name within each text."""
    m = M.gazetteer(texts(spark, d), ALIASES, SITES, COUNTRIES)
    return m.withColumn("confidence", F.round("confidence", 6)).orderBy("item_key", "kind", F.desc("confidence"), "place")


@query(f"""WITH {_sql_gazetteer()} SELECT kind, place, item_key, round(confidence, 6) AS confidence, count(*) OVER (PARTITION BY kind, place) AS items, row_number() OVER (PARTITION BY kind, place ORDER BY item_key DESC)::INTEGER AS nth
           FROM b WHERE confidence >= 0.5 QUALIFY nth <= 20""")
def items_of_places(spark, d):
    """The 20 newest items of each place and country whose match is sure enough, and how many there are."""
    m = M.gazetteer(texts(spark, d), ALIASES, SITES, COUNTRIES).where("confidence >= 0.5")
    m = stored(m, "placed").withColumn("confidence", F.round("confidence", 6))
    newest = Window.partitionBy("kind", "place").orderBy(F.desc("item_key"))
    top = m.withColumn("nth", F.row_number().over(newest)).where("nth <= 20")
    return top.join(m.groupBy("kind", "place").agg(F.count("*").alias("items")), ["kind", "place"]).select("kind", "place", "item_key", "confidence", "items", "nth")


@query(f"""WITH {_sql_gazetteer()}, due AS (SELECT doc_id AS item_key FROM documents WHERE doc_id % 2 = 1 ORDER BY doc_id DESC LIMIT 2000)
           SELECT (SELECT count(*) FROM due) AS swept, count(DISTINCT b.item_key) AS matched, count(*) FILTER (kind = 'site') AS places, count(*) FILTER (kind = 'site' AND confidence >= 0.75) AS plottable, count(*) FILTER (kind = 'country') AS countries FROM b JOIN due ON b.item_key = due.item_key""")
def location_sweep(spark, d):
    """One sweep over texts that the ledger lacks at this version, newest first, 2,000 at most; the ledger gets a row for each."""
    t = texts(spark, d)
    ledger = t.where("item_key % 2 = 0").select("item_key")
    due = t.join(ledger, "item_key", "left_anti").orderBy(F.desc("item_key")).limit(2000)
    m = M.gazetteer(due, ALIASES, SITES, COUNTRIES)
    site = F.col("kind") == "site"
    both = due.select("item_key").join(m, "item_key", "left")
    n = F.count_if
    return both.agg(F.count_distinct("item_key").alias("swept"), F.count_distinct(F.when(F.col("kind").isNotNull(), F.col("item_key"))).alias("matched"), n(site).alias("places"), n(site & (F.col("confidence") >= 0.75)).alias("plottable"), n(~site).alias("countries"))


@query(f"""WITH st AS ({STATE_SQL}), v AS (SELECT user_id AS item_key, arg_max(event_type, (ts, event_id)) AS source, arg_max(value, (ts, event_id)) AS value, min(ts) AS first_seen, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS beats FROM events GROUP BY 1)
           SELECT v.item_key, source, value, beats, first_seen, saved_at FROM st JOIN v ON st.item_key = v.item_key WHERE saved_at IS NOT NULL""")
def saved_items(spark, d):
    """Saved items with their current version, beats of all versions, first seen and saved time."""
    saved = V.replay_state(state_log(spark, d)).where("saved_at is not null").select("item_key", "saved_at")
    mine = versions(spark, d).join(saved.select("item_key"), "item_key", "left_semi")
    now = V.current(mine, ["item_key"]).select("item_key", F.col("beat").alias("source"), "value")
    union = mine.groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_set("beat")), ",").alias("beats"), F.min("fetched_at").alias("first_seen"))
    return now.join(union, "item_key").join(saved, "item_key")


NAMES_SQL = "n AS (SELECT o_custkey AS item_key, o_orderkey % 7 AS repo_id, min(o_orderdate) AS first_seen_at, max(o_orderdate) AS last_seen_at FROM orders GROUP BY 1, 2)"


def repo_names(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_key"), (F.col("o_orderkey") % 7).alias("repo_id")).agg(F.min("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("last_seen_at"))


@query(f"WITH {NAMES_SQL} SELECT item_key, repo_id, last_seen_at FROM n QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY last_seen_at DESC, repo_id DESC) = 1")
def current_repo_ids(spark, d):
    return V.newest(repo_names(spark, d).drop("first_seen_at"), ["item_key"], "last_seen_at", "repo_id")


@query(f"WITH {NAMES_SQL} SELECT repo_id, count(*) AS names, arg_min(item_key, (first_seen_at, item_key)) AS first_name, arg_max(item_key, (first_seen_at, item_key)) AS last_name, max(last_seen_at) AS last_seen_at FROM n GROUP BY 1")
def repo_name_history(spark, d):
    """Names of each repository in order of first_seen_at and key: how many, the first and the last."""
    order = F.struct("first_seen_at", "item_key")
    return repo_names(spark, d).groupBy("repo_id").agg(F.count("*").alias("names"), F.min_by("item_key", order).alias("first_name"), F.max_by("item_key", order).alias("last_name"), F.max("last_seen_at").alias("last_seen_at"))


@query("""WITH s AS (SELECT c_custkey AS k, count(*) AS n, max(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.6 END) AS strength, min(o_orderdate) AS first_at FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 5 IN (0, 1) GROUP BY 1)
          SELECT lower(replace(c_mktsegment, ' ', '-')) || '/repo-' || c_custkey AS repo_key, n AS mentions, strength::DOUBLE AS strength, first_at FROM s JOIN customer ON k = c_custkey""")
def discussion_overlaps(spark, d):
    """Orders as stories about customers' repositories: some link, some name them in the title, some only in part."""
    owner = F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit("-")))
    c = table(spark, d, "customer").select("c_custkey", owner.alias("owner"))
    repos = c.select(F.concat("owner", F.lit("/repo-"), "c_custkey").alias("repo_key"), F.concat(F.lit("Repo-"), "c_custkey").alias("name"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 5
    url = F.when(k == 0, F.concat(F.lit("https://github.com/"), F.initcap("owner"), F.lit("/Repo-"), "c_custkey", F.lit("/issues"))).otherwise("https://other.example/")
    title = F.when(k == 1, F.concat(F.lit("Show: the new repo "), "c_custkey", F.lit("!"))).when(k == 2, F.concat(F.lit("repo and "), "c_custkey")).otherwise("nothing here")
    stories = o.select(F.col("o_orderkey").alias("story_key"), title.alias("title"), url.alias("url"), F.col("o_orderdate").alias("fetched_at"))
    return M.discussion_overlap(repos, stories, least_slug=5)


PIN_RULES = [
    {"id": "new-signup", "priority": 2, "source_id": "signup", "applies_to": ["signal"], "enabled": True, "recency_bound_days": 3},
    {"id": "high-score", "priority": 1, "source_id": "view", "applies_to": ["signal", "read"], "enabled": True, "recency_bound_days": 10, "json_paths": ["metrics.0.score", "k"], "comparator": "gte", "threshold": 90},
    {"id": "over-95", "priority": 1, "source_id": "view", "applies_to": ["signal"], "enabled": True, "recency_bound_days": 30, "json_paths": ["k"], "comparator": "gt", "threshold": 95},
    {"id": "off", "priority": 1, "source_id": "error", "applies_to": ["signal"], "enabled": False, "recency_bound_days": 30},
    {"id": "read-only", "priority": 1, "source_id": "error", "applies_to": ["read"], "enabled": True, "recency_bound_days": 30},
]


@query(f"""WITH e AS (SELECT event_id, event_type, (props::JSON ->> '$.k')::DOUBLE AS k, CASE WHEN event_id % 6 <> 0 THEN epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts) END / 86400000.0 AS age, event_id % 2 = 0 AS nested, event_id % 7 = 0 AS told FROM events),
    r AS (SELECT event_id, 2 AS p, 'new-signup' AS id FROM e WHERE event_type = 'signup' AND age <= 3 UNION ALL SELECT event_id, 1, 'high-score' FROM e WHERE event_type = 'view' AND age <= 10 AND k >= 90 AND NOT told
          UNION ALL SELECT event_id, 1, 'over-95' FROM e WHERE event_type = 'view' AND age <= 30 AND k > 95 AND NOT nested AND NOT told)
    SELECT event_id AS item_id, string_agg(id, ',' ORDER BY p, id) AS rules, min(p)::INTEGER AS priority FROM r GROUP BY 1""")
def pinned_by_rules(spark, d):
    """Rules by source and by a number in the payload (nested in an array or not; never a string), each with its recency bound."""
    k = F.get_json_object("props", "$.k")
    number = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"metrics":[{"score":'), number, F.lit("}]}"))).otherwise(F.concat(F.lit('{"k":'), number, F.lit("}")))
    rows = table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("source_id"), F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("published_at"), raw.alias("raw_json"))
    return M.overrides(rows, PIN_RULES, "signal", NOW)


WEEK_SQL = f"""{BEST_SQL}, k AS (SELECT b.item_key, b.beat, b.decayed, CASE WHEN c_nationkey = 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'wrong kind' WHEN b.computed_at < TIMESTAMP '1997-01-01' THEN 'outside week'
        WHEN b.item_key % 7 = 0 THEN 'already read' WHEN b.item_key % 11 = 0 THEN 'dismissed' END AS reason, CASE WHEN c_acctbal >= 5000 THEN 'body' ELSE 'headline' END AS level FROM b JOIN customer ON c_custkey = b.item_key WHERE b.beat <> '5-LOW'),
    m AS (SELECT *, CASE WHEN reason IS NULL THEN level END AS list, row_number() OVER (ORDER BY decayed DESC, item_key) AS r FROM k),
    q AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY r) AS n FROM m), z AS (SELECT CASE WHEN count(*) = 2 THEN max(r) END AS stop FROM q WHERE (list = 'body' AND n = 12) OR (list = 'headline' AND n = 10))"""


def weekly(spark, d):
    """Items in read order with the reason that keeps each off the lists, or its list."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item_key"), "c_nationkey", "c_mktsegment", "c_acctbal")
    # an unknown kind never matches
    kind = F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment"))
    reason = F.when(~F.coalesce(kind.isin("BUILDING", "MACHINERY", "FURNITURE"), F.lit(False)), "wrong kind").when(F.col("computed_at") < F.lit("1997-01-01").cast("timestamp"), "outside week").when(F.col("item_key") % 7 == 0, "already read").when(F.col("item_key") % 11 == 0, "dismissed")
    rows = best(spark, d).where("beat <> '5-LOW'").join(c, "item_key").withColumn("reason", reason)
    return rows.select("item_key", "beat", "decayed", "reason", F.when(F.col("reason").isNull(), F.when(F.col("c_acctbal") >= 5000, "body").otherwise("headline")).alias("list"))


@query(f"WITH {WEEK_SQL} SELECT list, n::INTEGER AS place, item_key, beat, decayed FROM q WHERE (list = 'body' AND n <= 12) OR (list = 'headline' AND n <= 10)")
def weekly_list(spark, d):
    w = Window.partitionBy("list").orderBy(F.desc("decayed"), "item_key")
    rows = weekly(spark, d).where("list is not null").withColumn("place", F.row_number().over(w))
    return rows.where(F.col("place") <= F.when(F.col("list") == "body", 12).otherwise(10)).select("list", "place", "item_key", "beat", "decayed")


@query(f"WITH {WEEK_SQL} SELECT coalesce(reason, 'considered') AS outcome, count(*) AS n FROM q, z WHERE stop IS NULL OR r <= stop GROUP BY 1")
def weekly_scan(spark, d):
    """What became of the rows that the scan saw before both lists were full."""
    seen = M.scanned(weekly(spark, d), [-F.col("decayed"), F.col("item_key")], {"body": 12, "headline": 10})
    return seen.groupBy(F.coalesce("reason", F.lit("considered")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {BEST_SQL}, s AS (SELECT b.*, CASE WHEN c_nationkey <> 0 THEN c_mktsegment END AS kind, item_key % 7 = 0 AS saved FROM b JOIN customer ON c_custkey = item_key WHERE item_key % 11 <> 0),
      k AS (SELECT * FROM s WHERE kind = 'BUILDING'), o AS (SELECT *, row_number() OVER (ORDER BY pinned DESC, priority, decayed DESC, item_key DESC) AS place, count(*) OVER () AS total FROM k)
      SELECT place::INTEGER AS place, item_key, beat, kind, decayed, pinned, priority, saved, total, CASE WHEN place = 30 AND total > 30 THEN (CASE WHEN pinned THEN '1' ELSE '0' END) || ',' || priority || ',' || item_key END AS next_after FROM o WHERE place <= 30""")
def feed_full(spark, d):
    """A first page of the feed with kind filter: not dismissed, total, and where the next page begins."""
    return feed(spark, d, kind="BUILDING", limit=30)


def feed(spark, d, kind: str, limit: int):
    """Feed rows after state and kind filters; at most 200 a page."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item_key"), F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment")).alias("kind"))
    dismissed, saved = F.col("item_key") % 11 == 0, F.col("item_key") % 7 == 0
    rows = best(spark, d).join(c, "item_key").where(~dismissed & (F.col("kind") == kind)).withColumn("saved", saved)
    total = rows.groupBy("kind").agg(F.count("*").alias("total"))
    order = [F.desc("pinned"), F.col("priority"), F.desc("decayed"), F.desc("item_key")]
    page = rows.orderBy(*order).limit(limit)  # a bounded page, then numbered
    page = page.withColumn("place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(total), "kind")
    after = F.concat_ws(",", F.when(F.col("pinned"), "1").otherwise("0"), F.col("priority").cast("string"), F.col("item_key").cast("string"))
    return page.select("place", "item_key", "beat", "kind", "decayed", "pinned", "priority", "saved", "total", F.when((F.col("place") == limit) & (F.col("total") > limit), after).alias("next_after"))


FEED_NOW = "2024-01-20 12:00:00"
FEED_HALVES = [("view", 48.0), ("purchase", 96.0), ("signup", 24.0), ("error", 12.0)]
FEED_RULES = [
    {"id": "fresh-signup", "priority": 2, "source_id": "signup", "applies_to": ["signal"], "enabled": True, "recency_bound_days": 3},
    {"id": "high-k", "priority": 1, "source_id": "view", "applies_to": ["signal", "read"], "enabled": True, "recency_bound_days": 10, "json_paths": ["k"], "comparator": "gte", "threshold": 60},
]
FEED_SQL = f"""v AS (SELECT user_id AS item_key, arg_max(event_type, (ts, event_id)) AS source_id, arg_max(ts, (ts, event_id)) AS at_, arg_max(props, (ts, event_id)) AS props FROM events WHERE ts <= TIMESTAMP '{FEED_NOW}' GROUP BY 1),
    st AS (SELECT user_id AS item_key, min(ts) FILTER (event_type = 'purchase' AND value >= 60) AS saved_at, min(ts) FILTER (event_type = 'error' AND value >= 90) AS dismissed_at FROM events GROUP BY 1),
    sc AS (SELECT user_id AS item_key, event_type AS beat, ts AS computed_at, value FROM events WHERE ts <= TIMESTAMP '{FEED_NOW}' AND event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
    de AS (SELECT sc.*, round(value * pow(0.5, (epoch(TIMESTAMP '{FEED_NOW}') - epoch(computed_at)) / 3600 / hl), 6) AS score FROM sc JOIN (VALUES {", ".join(f"('{b}', {h})" for b, h in FEED_HALVES)}) AS h(b, hl) ON beat = b),
    bb AS (SELECT * FROM de QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY score DESC, beat) = 1),
    rn AS (SELECT DISTINCT date_trunc('week', ts) AS run_at FROM events), mb AS (SELECT DISTINCT date_trunc('week', ts) AS run_at, event_type AS c, user_id AS item_key FROM events WHERE value > 100),
    mz AS (SELECT run_at, item_key, max(n) AS n FROM mb JOIN (SELECT run_at, c, count(*) AS n FROM mb GROUP BY ALL) USING (run_at, c) GROUP BY ALL),
    fe AS (SELECT v.item_key, source_id, CASE source_id WHEN 'view' THEN 'news' WHEN 'purchase' THEN 'news' WHEN 'signup' THEN 'advisory' END AS kind, beat, score, saved_at,
             CASE WHEN source_id = 'view' AND epoch(TIMESTAMP '{FEED_NOW}') - epoch(at_) <= 864000 AND (props::JSON ->> '$.k')::DOUBLE >= 60 THEN 1 WHEN source_id = 'signup' AND epoch(TIMESTAMP '{FEED_NOW}') - epoch(at_) <= 259200 THEN 2 END::INTEGER AS priority,
             coalesce((SELECT n FROM mz WHERE mz.item_key = v.item_key AND mz.run_at = (SELECT max(run_at) FROM rn WHERE run_at <= computed_at)), 1) AS cluster_size
           FROM v JOIN bb ON bb.item_key = v.item_key JOIN st ON st.item_key = v.item_key WHERE dismissed_at IS NULL)"""


def feed_as_of(spark, d, asked):
    """Events as versions, scores and states of items: the feed's rows as of an instant."""
    e = table(spark, d, "events")
    key, seq = F.col("user_id").alias("item_key"), F.col("event_id").alias("ingest_seq")
    versions = e.select(key, F.col("ts").cast("timestamp").alias("fetched_at"), seq, F.col("event_type").alias("source_id"), "props")
    scores = e.where("event_id % 3 <> 0").select(key, F.col("event_type").alias("beat"), F.col("ts").alias("computed_at"), F.col("event_id").alias("seq"), F.col("value").alias("signal"), (F.col("value") / 2).alias("read"))
    of = lambda kind, least: F.min(F.when((F.col("event_type") == kind) & (F.col("value") >= least), F.col("ts")))
    states = e.groupBy(key).agg(of("purchase", 60).alias("saved_at"), of("error", 90).alias("dismissed_at"))
    kinds = local_rows(spark, [("view", "news"), ("purchase", "news"), ("signup", "advisory")], "source_id string, kind string")
    runs, members = cluster_runs(spark, d)

    def pins(items, profile, now):
        rows = items.select(F.col("item_key").alias("item_id"), "source_id", F.col("fetched_at").alias("published_at"), F.col("props").alias("raw_json"))
        return M.overrides(rows, FEED_RULES, profile, now).select(F.col("item_id").alias("item_key"), "priority")

    return FD.rows(asked, versions, scores, local_rows(spark, FEED_HALVES, "beat string, hl double"), states, kinds, pins, runs, members)


FEED_OUT = ["item_key", "source_id", "kind", "beat", "score", "pinned", "priority", "cluster_size", "saved_at", "total"]
FEED_ROWS_SQL = "item_key, source_id, kind, beat, score, priority IS NOT NULL AS pinned, priority, cluster_size, saved_at, count(*) OVER () AS total"


@query(f"WITH {FEED_SQL} SELECT {FEED_ROWS_SQL} FROM fe WHERE kind = 'news' ORDER BY pinned DESC, priority NULLS LAST, score DESC, item_key DESC LIMIT 40")
def feed_of_a_kind(spark, d):
    """The first page of one kind as of an instant."""
    asked = FD.Asked(FEED_NOW, kind="news")
    return FD.page(feed_as_of(spark, d, asked), asked, 40).select(*FEED_OUT)


@query(f"WITH {FEED_SQL} SELECT {FEED_ROWS_SQL} FROM fe ORDER BY pinned DESC, priority NULLS LAST, score DESC, item_key DESC LIMIT 12")
def feed_chained(spark, d):
    """Three pages of 4, each begun from the cursor that the page before it gave, equal one page of 12."""
    asked, pages = FD.Asked(FEED_NOW), []
    for _ in range(3):
        got = stored(FD.page(feed_as_of(spark, d, asked), asked, 4), "feed-page")
        pages.append(got.select(*FEED_OUT))
        last = got.where("next_after IS NOT NULL").first()
        if last is None:
            break
        asked = FD.Asked.of(last.next_after)
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


USAGE_SQL = """u AS (SELECT ts::DATE AS day, event_id, ts, event_type, value, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN ['timeout', 'over_budget', 'bad_answer'][event_id % 3 + 1] END AS reason, event_type <> 'view' AS counted, event_id % 4 <> 0 AS costed, CASE WHEN event_id % 50 = 0 THEN 'UTC' ELSE 'America/New_York' END AS tz FROM events)"""


def calls(spark, d):
    """Events as model calls: reasons of failures, calls without token counts or measured cost, two zones."""
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.to_date("ts").alias("day"), k, "ts", "value", (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, ["timeout", "over_budget", "bad_answer"])), (k % 3 + 1).cast("int"))).alias("reason"),
        (F.col("event_type") != "view").alias("counted"), (k % 4 != 0).alias("costed"), F.when(k % 50 == 0, "UTC").otherwise("America/New_York").alias("tz"),
    )


@query(f"""WITH {USAGE_SQL}, a AS (SELECT day, count(*) AS calls, count(*) FILTER (ok) AS ok_calls, count(*) FILTER (NOT ok) AS unavailable_calls, round(coalesce(sum(value) FILTER (ok AND counted), 0), 4) AS counted_tokens, count(*) FILTER (ok AND NOT counted) AS unmetered_ok_calls,
      round(coalesce(sum(value / 1000) FILTER (costed), 0), 6) AS amount_usd, count(*) FILTER (NOT costed) AS unmeasured_cost_calls, array_to_string(list_sort(list(DISTINCT tz)), ',') AS timezones, count(DISTINCT tz) > 1 AS mixed_timezone FROM u GROUP BY 1)
      SELECT *, unmeasured_cost_calls = 0 AS cost_measured, round(counted_tokens + 100 * unmetered_ok_calls, 4) AS charged_tokens, round(greatest(0, 15000 - (counted_tokens + 100 * unmetered_ok_calls)), 4) AS remaining_tokens, CASE WHEN counted_tokens + 100 * unmetered_ok_calls >= 15000 THEN 'closed' ELSE 'open' END AS status FROM a""")
def call_usage(spark, d):
    """Usage by day, with a flat charge for calls without a token count, against the daily ceiling."""
    ok, n = F.col("ok"), F.count_if
    a = calls(spark, d).groupBy("day").agg(
        F.count("*").alias("calls"), n(ok).alias("ok_calls"), n(~ok).alias("unavailable_calls"), F.round(F.coalesce(F.sum(F.when(ok & F.col("counted"), F.col("value"))), F.lit(0.0)), 4).alias("counted_tokens"), n(ok & ~F.col("counted")).alias("unmetered_ok_calls"),
        F.round(F.coalesce(F.sum(F.when(F.col("costed"), F.col("value") / 1000)), F.lit(0.0)), 6).alias("amount_usd"), n(~F.col("costed")).alias("unmeasured_cost_calls"), F.array_join(F.array_sort(F.collect_set("tz")), ",").alias("timezones"),
    )
    charged = F.col("counted_tokens") + 100 * F.col("unmetered_ok_calls")
    return a.withColumns({"mixed_timezone": F.col("timezones").contains(","), "cost_measured": F.col("unmeasured_cost_calls") == 0, "charged_tokens": F.round(charged, 4), "remaining_tokens": F.round(F.greatest(F.lit(0.0), 15000 - charged), 4), "status": F.when(charged >= 15000, "closed").otherwise("open")})


@query(f"""WITH {USAGE_SQL}, t AS (SELECT *, coalesce(reason, '') <> 'over_budget' AS tried FROM u)
      SELECT day, count(*) FILTER (tried) AS attempts, count(*) FILTER (tried AND coalesce(reason, '') <> 'timeout') AS reached, count(*) FILTER (reason = 'timeout') AS unreached, count(*) FILTER (NOT tried) AS refusals, arg_max(event_id, (ts, event_id)) FILTER (tried) AS latest, arg_max(coalesce(reason, 'none'), (ts, event_id)) FILTER (tried) AS latest_reason FROM t GROUP BY 1""")
def call_reach(spark, d):
    """Attempts by day: refusals for cost are none; the latest attempt and its reason."""
    reason = F.coalesce("reason", F.lit("none"))
    tried, late = reason != "over_budget", reason == "timeout"
    at = F.when(tried, F.struct("ts", "event_id"))
    n = F.count_if
    return calls(spark, d).groupBy("day").agg(n(tried).alias("attempts"), n(tried & ~late).alias("reached"), n(late).alias("unreached"), n(~tried).alias("refusals"), F.max_by("event_id", at).alias("latest"), F.max_by(reason, at).alias("latest_reason"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'alpha beta gamma delta' WHEN 2 THEN '<!-- digest: x --> alpha beta gamma delta epsilon' ELSE 'alpha beta  gamma delta epsilon zeta' END AS said FROM conversations)
      SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'restated_headline' WHEN 2 THEN 'contains_marker' END AS reason, CASE WHEN turn % 4 = 3 THEN 'alpha beta gamma delta epsilon zeta' END AS text FROM t""")
def generated_texts(spark, d):
    """Generated one-liners: white space collapsed, an emitted label cut, empty, marked or restating ones refused."""
    k = F.col("turn") % 4
    said = F.when(k == 0, " ANSWER: ").when(k == 1, "Worth: alpha beta gamma delta").when(k == 2, "<!-- digest: x --> alpha beta gamma delta epsilon").otherwise("ARGUES:  alpha beta  gamma\n delta epsilon zeta")
    line = F.trim(F.regexp_replace(F.trim(F.regexp_replace(said, r"\s+", " ")), r"(?i)^(?:ARGUES|WORTH|ANSWER)\s*:\s*", ""))
    few = novel_words(F.lit("the title"), line) < 5
    reason = F.when(line == "", "empty").when(line.rlike(r"(?i)<!--\s*digest:"), "contains_marker").when(few, "restated_headline")
    return table(spark, d, "conversations").select("conv_id", "turn", reason.alias("reason"), F.when(reason.isNull(), line).alias("text"))
