"""Titles, clusters, URLs, dates and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.dates import publication_date
from tidewatch.operators import clusters as C
from tidewatch.plans import query
from tidewatch.operators.asof import in_force
from tidewatch.operators.terms import find_terms
from tidewatch.session import table

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
TOKENS_SQL = f"""t AS (SELECT doc_id AS item_key, source, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(nfc_normalize(split_part(text, chr(10), 1))), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({STOP_SQL})) AS w FROM documents),
    s AS (SELECT DISTINCT item_key, source, array_to_string(w[i:i + 2], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0))"""
PAIRS_SQL = TOKENS_SQL + """, r AS (SELECT * FROM s WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) <= 5)),
    n AS (SELECT item_key, count(*) AS n FROM r GROUP BY 1),
    q AS (SELECT x.item_key AS a, y.item_key AS b, count(*) AS shared FROM r x JOIN r y ON x.shingle = y.shingle AND x.item_key < y.item_key AND x.source <> y.source GROUP BY 1, 2),
    p AS (SELECT * FROM (SELECT a, b, round(shared / (na.n + nb.n - shared)::DOUBLE, 6) AS score FROM q JOIN n na ON na.item_key = a JOIN n nb ON nb.item_key = b) WHERE score >= 0.1)"""
CLUSTER_SQL = PAIRS_SQL + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT a AS item_key, a AS c FROM e UNION SELECT w.item_key, e.b FROM w JOIN e ON e.a = w.c),
    m AS (SELECT item_key, min(c) AS cluster_id FROM w GROUP BY 1), k AS (SELECT m.*, count(*) OVER (PARTITION BY cluster_id) AS size FROM m)"""


def titles(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), "source", T.first_line(F.col("text")).alias("title"))


@query(f"WITH {TOKENS_SQL} SELECT * FROM s")
def title_shingles(spark, d):
    return C.shingled(titles(spark, d))


@query(f"WITH {TOKENS_SQL} SELECT shingle, count(*) AS df FROM s GROUP BY shingle")
def shingle_df(spark, d):
    return C.shingled(titles(spark, d)).groupBy("shingle").agg(F.count("*").alias("df"))


@query(f"WITH {PAIRS_SQL} SELECT * FROM p")
def near_dup_pairs(spark, d):
    return C.pairs(C.shingled(titles(spark, d)))


@query(f"WITH RECURSIVE {CLUSTER_SQL} SELECT * FROM k")
def near_dup_clusters(spark, d):
    return C.clusters(C.pairs(C.shingled(titles(spark, d))))


@query("""WITH runs AS (SELECT DISTINCT date_trunc('week', ts) AS run_at FROM events),
      m AS (SELECT date_trunc('week', ts) AS run_at, event_type AS cluster_id, user_id AS item_key FROM events WHERE value > 100 GROUP BY ALL),
      s AS (SELECT event_id, user_id AS item_key, ts AS computed_at, run_at FROM events ASOF JOIN runs ON ts >= run_at),
      z AS (SELECT run_at, cluster_id, count(*) AS n FROM m GROUP BY ALL),
      i AS (SELECT m.run_at, m.item_key, max(n) AS n FROM m JOIN z ON m.run_at = z.run_at AND m.cluster_id = z.cluster_id GROUP BY ALL)
      SELECT s.event_id, s.item_key, coalesce(i.n, 1) AS cluster_size FROM s LEFT JOIN i ON s.run_at = i.run_at AND s.item_key = i.item_key""")
def cluster_size_as_of(spark, d):
    """The run in force at each instant is chosen over the whole run table, then membership in that run only (else size 1)."""
    runs, members = cluster_runs(spark, d)
    s = table(spark, d, "events").select("event_id", F.col("user_id").alias("item_key"), "ts")
    s = in_force(s, "ts", runs, "run_at", "week")
    return s.join(members, ["run_at", "item_key"], "left").select("event_id", "item_key", F.coalesce("n", F.lit(1)).alias("cluster_size"))


def cluster_runs(spark, d):
    """(runs, members): the times of weekly clustering runs, and each run's items with the size of their cluster."""
    e = table(spark, d, "events")
    run = F.date_trunc("week", "ts").cast("timestamp_ntz")
    member = e.where("value > 100").select(run.alias("run_at"), F.col("event_type").alias("cluster_id"), F.col("user_id").alias("item_key")).distinct()
    sizes = member.groupBy("run_at", "cluster_id").agg(F.count("*").alias("n"))
    return e.select(run.alias("run_at")).distinct(), member.join(sizes, ["run_at", "cluster_id"]).groupBy("run_at", "item_key").agg(F.max("n").alias("n"))


HOSTS = ", ".join(f"'{h}'" for h in T.HTTPS_HOSTS)
URL_SQL = """u AS (SELECT page_id, split_part(trim(url), '#', 1) AS b FROM pages),
    v AS (SELECT page_id, lower(regexp_extract(b, '(?i)^(https?)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(b, '(?i)^https?://([^/?]*)', 1)), '^(www\\.)+', '') AS host,
          regexp_replace(regexp_extract(b, '(?i)^https?://[^/?]*([^?]*)', 1), '/+$', '') AS path,
          list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_|at_).*$|^(fbclid|gclid|mc_cid|mc_eid)$')) AS q FROM u),
    c AS (SELECT page_id, CASE WHEN scheme <> '' THEN (CASE WHEN host IN ({HOSTS}) OR suffix(host, '.blogspot.com') OR suffix(host, '.substack.com') THEN 'https' ELSE scheme END) || '://' || host || (CASE WHEN path = '' THEN '/' ELSE path END)
          || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END) END AS canonical_url FROM v)""".replace("{HOSTS}", HOSTS)


@query(f"WITH {URL_SQL} SELECT * FROM c")
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"WITH {URL_SQL} SELECT sha256(canonical_url) AS item_key, count(*) AS n_pages, min(page_id) AS first_page FROM c WHERE canonical_url IS NOT NULL GROUP BY 1")
def item_keys(spark, d):
    c = canonical_urls(spark, d).where("canonical_url is not null")
    return c.groupBy(F.sha2("canonical_url", 256).alias("item_key")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) END AS published_at FROM events""")
def parsed_dates(spark, d):
    k, ts = F.col("event_id") % 5, F.col("ts")
    forms = F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).when(k == 2, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 3, F.unix_seconds(ts.cast("timestamp")).cast("string")).otherwise(F.date_format(ts, "yyyy-02-30"))
    return table(spark, d, "events").select("event_id", forms.alias("s")).select("event_id", publication_date(F.col("s")).cast("timestamp_ntz").alias("published_at"))


ZONE = "America/New_York"


@query(f"SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')::DATE AS local_day, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m-%d-%H') AS local_hour FROM events")
def local_days(spark, d):
    at = F.from_utc_timestamp(F.col("ts").cast("timestamp"), ZONE)
    return table(spark, d, "events").select("event_id", F.to_date(at).alias("local_day"), F.date_format(at, "yyyy-MM-dd-HH").alias("local_hour"))


@query("""SELECT day, isoyear(day)::INTEGER AS iso_year, week(day)::INTEGER AS iso_week, isoyear(day) || '-W' || lpad(week(day)::VARCHAR, 2, '0') AS label, date_trunc('week', day)::DATE AS monday, (date_trunc('week', day) + INTERVAL 6 DAY)::DATE AS sunday
          FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)""")
def iso_weeks(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    year, week = F.expr("cast(extract(YEAROFWEEK from day) as int)"), F.weekofyear("day")
    monday = F.to_date(F.date_trunc("week", "day"))
    return days.select("day", year.alias("iso_year"), week.alias("iso_week"), F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")).alias("label"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"))


@query(f"""SELECT day, (((day + 1)::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC') - INTERVAL 1 MILLISECOND AS day_end FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)""")
def day_end_instants(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    end = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), ZONE) - F.expr("interval 1 millisecond")
    return days.select("day", end.cast("timestamp_ntz").alias("day_end"))


TERMS = ["the", "on the", "licensed under", "apache license", "worthless", "mail"]
TERM_SQL = " UNION ALL ".join(f"SELECT doc_id AS item_key, '{t}' AS term FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])" + r"[\s-]+".join(t.split()) + "($|[^\\p{L}\\p{N}_])')" for t in TERMS)


def matches(spark, d):
    """(item_key, term) of every text and the terms that it holds, by the term index."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), "text")
    return find_terms(docs, "item_key", ["text"], [(t, False) for t in TERMS]).select("item_key", "term")


@query(TERM_SQL)
def term_matches(spark, d):
    return matches(spark, d)


@query(f"""WITH m AS ({TERM_SQL}), w AS (SELECT item_key, sum(CASE WHEN term IN ('apache license', 'licensed under') THEN 0.5 WHEN term = 'mail' THEN 1.0 ELSE 0 END) AS b, sum(CASE WHEN term = 'worthless' THEN 1.0 ELSE 0 END) AS s FROM m GROUP BY 1)
           SELECT doc_id AS item_key, round(greatest(0.05, least(3.0, 1 + 0.5 * coalesce(b, 0) - 0.8 * coalesce(s, 0))), 6)::DOUBLE AS multiplier FROM documents LEFT JOIN w ON doc_id = item_key""")
def interest_multiplier(spark, d):
    from tidewatch.functions.scoring import interest_multiplier as multiplier

    boost = F.sum(F.when(F.col("term").isin("apache license", "licensed under"), 0.5).when(F.col("term") == "mail", 1.0).otherwise(0.0))
    w = matches(spark, d).groupBy("item_key").agg(boost.alias("b"), F.sum(F.when(F.col("term") == "worthless", 1.0).otherwise(0.0)).alias("s"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return docs.join(w, "item_key", "left").select("item_key", F.round(multiplier(zero("b"), zero("s")), 6).alias("multiplier"))


@query("""WITH b AS (SELECT doc_id AS item_key, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n,
             len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 4))) AS fresh, length(text) > 6000 AS truncated FROM documents)
          SELECT item_key, n AS words, CASE WHEN n >= 400 THEN 'body' WHEN fresh >= 8 THEN 'excerpt' ELSE 'headline' END AS evidence,
             CASE WHEN n >= 400 THEN greatest(1, round(n / 200.0))::INTEGER END AS minutes, n >= 400 AND truncated AS truncated FROM b""")
def text_evidence(spark, d):
    docs = table(spark, d, "documents")
    n = F.size(T.words(F.col("text"))).cast("long")
    fresh = F.size(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 4)))
    rows = docs.select(F.col("doc_id").alias("item_key"), n.alias("words"), fresh.alias("fresh"), (F.length("text") > 6000).alias("long"))
    body = F.col("words") >= 400
    return rows.select("item_key", "words", F.when(body, "body").when(F.col("fresh") >= 8, "excerpt").otherwise("headline").alias("evidence"), F.when(body, F.greatest(F.lit(1), F.round(F.col("words") / 200).cast("int"))).alias("minutes"), (body & F.col("long")).alias("truncated"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
       ok AS (SELECT * FROM p WHERE NOT regexp_matches(line, '^\\s*(#|>|\\||```|---|!\\[)') AND NOT contains(line, ' | ') AND len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) >= 4 AND length(trim(line)) >= 20)
       SELECT doc_id AS item_key, arg_min(trim(line), pos) AS paragraph FROM ok GROUP BY 1""")
def first_paragraph(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    prose = ~F.col("line").rlike(r"^\s*(#|>|\||```|---|!\[)") & ~F.col("line").contains(" | ") & (F.size(T.words(F.col("line"))) >= 4) & (F.length(F.trim("line")) >= 20)
    return p.where(prose).groupBy("item_key").agg(F.min_by(F.trim("line"), "at").alias("paragraph"))


@query("""SELECT page_id, CASE WHEN contains(url, '.gov') OR contains(url, 'official') THEN 'event' WHEN contains(lower(html), 'announces') OR contains(lower(html), 'press release') THEN 'press' ELSE 'analysis' END AS item_type FROM pages""")
def item_types(spark, d):
    low = F.lower("html")
    kind = F.when(F.col("url").contains(".gov") | F.col("url").contains("official"), "event").when(low.contains("announces") | low.contains("press release"), "press").otherwise("analysis")
    return table(spark, d, "pages").select("page_id", kind.alias("item_type"))
