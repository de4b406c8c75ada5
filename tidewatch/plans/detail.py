"""Item types, suppression, windows, terms, digests and listings with all their figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.functions.scoring import log_odds_z
from tidewatch.operators.terms import spaced
from tidewatch.operators.versions import newest
from tidewatch.plans import NOW, query
from tidewatch.plans.graphs import BASKET_SQL, FLOOR, NEIGHBOURS, mentions
from tidewatch.plans.ranking import HALF_LIVES, HALF_SQL, RANK_SQL, ranked
from tidewatch.plans.text import ZONE
from tidewatch.session import spread, stored, table

#: Sources that are governments themselves, and phrases of press releases (fixed values).
GOVERNMENT = ["federal-register", "whitehouse-actions", "scotus-slip", "nws-fl-alerts", "nvd-cve"]
PRESS = ["prnewswire", "pr newswire", "business wire", "businesswire", "globenewswire", "globe newswire", "forward-looking statements", "safe harbor statement", "for immediate release"]


def item_type(source, tier, title, summary):
    """By tier, then by a government's own sources, then by the phrases of press releases; else analysis."""
    said = F.lit(False)
    for phrase in PRESS:
        said = said | F.lower(title).contains(phrase) | F.coalesce(F.lower(summary).contains(phrase), F.lit(False))
    government = source.isin(*GOVERNMENT) | source.startswith("cisa-")
    return F.when(tier.isin("event", "analysis"), tier).when(government, "event").when(said, "press").otherwise("analysis")


@query("""SELECT c_custkey AS item_key, CASE WHEN c_custkey % 9 = 0 THEN 'event' WHEN c_custkey % 9 = 1 THEN 'analysis' WHEN c_custkey % 5 IN (0, 1) THEN 'event' WHEN c_custkey % 4 IN (0, 1) THEN 'press' ELSE 'analysis' END AS item_type FROM customer""")
def classified_items(spark, d):
    k = F.col("c_custkey")
    source = F.when(k % 5 == 0, "nvd-cve").when(k % 5 == 1, F.concat(F.lit("cisa-"), k)).otherwise("desk")
    tier = F.when(k % 9 == 0, "event").when(k % 9 == 1, "analysis")
    title = F.when(k % 4 == 0, F.concat("c_name", F.lit(" via PR Newswire"))).otherwise(F.col("c_name"))
    summary = F.when(k % 4 == 1, F.concat(F.lit("For Immediate Release: "), "c_mktsegment"))
    return table(spark, d, "customer").select(k.alias("item_key"), item_type(source, tier, title, summary).alias("item_type"))


@query("""SELECT c_custkey AS repo_id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'fork' END, CASE WHEN c_custkey % 3 = 0 THEN 'archived' END, CASE WHEN c_acctbal < 0 THEN 'no_readme' END, CASE WHEN c_custkey % 11 = 0 THEN 'dismissed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer""")
def suppressed_repos(spark, d):
    """Why a repository is suppressed: what it is itself, and that its item was dismissed."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, (k % 2 == 0).alias("fork"), (k % 3 == 0).alias("archived"), F.when(F.col("c_acctbal") >= 0, "text").alias("readme"))
    state = c.where(k % 11 == 0).select("c_custkey", F.lit(True).alias("dismissed"))
    r = c.join(state, "c_custkey", "left")
    reasons = F.array_compact(F.array(F.when(F.col("fork"), "fork"), F.when(F.col("archived"), "archived"), F.when(F.col("readme").isNull(), "no_readme"), F.when(F.col("dismissed"), "dismissed")))
    return r.select(k.alias("repo_id"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""WITH b AS (SELECT least(23, floor((epoch(ts) - epoch(TIMESTAMP '{NOW}') + 86400) / 3600))::INTEGER AS hour, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1),
           h AS (SELECT unnest(range(24))::INTEGER AS hour) SELECT h.hour, coalesce(n, 0) AS n, (SELECT sum(n) FROM b)::BIGINT AS total, (SELECT max(n) FROM b) AS most FROM h LEFT JOIN b ON h.hour = b.hour""")
def heat_strip(spark, d):
    """Items by hour of the last 24, oldest first, with the total and the most of an hour."""
    since = F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp")) - 86_400 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp")) - since
    rows = table(spark, d, "events").where((at >= 0) & (at <= 86_400 * 1_000_000)).groupBy(F.least(F.lit(23), F.floor(at / 3_600_000_000)).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    all_hours = spark.range(24).select(F.col("id").cast("int").alias("hour")).join(rows, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # 24 rows
    return all_hours.select("hour", "n", F.sum("n").over(w).alias("total"), F.max("n").over(w).alias("most"))


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS a, CASE WHEN event_id % 7 <> 0 THEN 'é' || user_id END AS b FROM events)
          SELECT event_id, sha256((CASE WHEN a IS NULL THEN '-1:' ELSE octet_length(a::BLOB) || ':' || a END) || '|' || (CASE WHEN b IS NULL THEN '-1:' ELSE (octet_length(user_id_::VARCHAR::BLOB) + 2) || ':' || b END)) AS cache_key FROM (SELECT k.*, user_id AS user_id_ FROM k JOIN events USING (event_id))""")
def cache_keys(spark, d):
    """Keys over length-prefixed fields (bytes); null is told from empty."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-1:"))
    a, b = F.when(F.col("event_id") % 4 != 0, F.col("event_type")), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("é"), "user_id"))
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", part(a), part(b)), 256).alias("cache_key"))


@query(f"""SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS monday, (((date_trunc('week', o_orderdate)::DATE + 7)::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC') - INTERVAL 1 MILLISECOND AS week_end FROM orders""")
def week_end_instants(spark, d):
    """The last instant of each local ISO week, across changes of the clock."""
    weeks = table(spark, d, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("monday")).distinct()
    end = F.to_utc_timestamp(F.date_add("monday", 7).cast("timestamp"), ZONE) - F.expr("interval 1 millisecond")
    return weeks.select("monday", end.cast("timestamp_ntz").alias("week_end"))


@query("""WITH s AS (SELECT doc_id % 40 AS source, doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS seen FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seen DESC NULLS LAST, doc_id) AS n, count(*) OVER (PARTITION BY source) AS all_ FROM s)
          SELECT source, doc_id, greatest(0, all_ - 15) AS capped FROM r WHERE n <= 15""")
def capped_sources(spark, d):
    """At most 15 newest rows a source, undated ones last, and how many were capped."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("source"), "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("at"))
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("at"), "doc_id")
    top = rows.withColumn("n", F.row_number().over(w)).where("n <= 15").select("source", "doc_id")
    return top.join(rows.groupBy("source").agg(F.greatest(F.lit(0), F.count("*") - 15).alias("capped")), "source")


@query(f"WITH {BASKET_SQL}, c AS (SELECT entity, count(*) AS items FROM p GROUP BY 1) SELECT count(*) AS entities_total, count(*) FILTER (items >= 20) AS at_or_above, count(*) FILTER (items < 20) AS below FROM c")
def entity_totals(spark, d):
    c = mentions(spark, d).groupBy("entity").agg(F.count("*").alias("items"))
    return c.agg(F.count("*").alias("entities_total"), F.count_if(F.col("items") >= 20).alias("at_or_above"), F.count_if(F.col("items") < 20).alias("below"))


@query(f"""WITH {BASKET_SQL}, q AS (SELECT unnest(['Brand#11', 'no such entity', 'Brand#23']) AS focus), c AS (SELECT entity, count(*) AS items FROM p GROUP BY 1),
      s AS (SELECT focus, y.entity, count(*) AS shared FROM q JOIN p x ON x.entity = focus JOIN p y ON y.item_key = x.item_key AND y.entity <> focus GROUP BY 1, 2),
      n AS (SELECT focus, count(*) FILTER (items >= {FLOOR}) AS above, count(*) FILTER (items < {FLOOR}) AS hidden FROM s JOIN c ON s.entity = c.entity GROUP BY 1)
      SELECT q.focus, c.entity IS NOT NULL AS known, coalesce(items, 0) AS item_count, least({NEIGHBOURS}, coalesce(above, 0)) AS shown, coalesce(above, 0) AS above_threshold, coalesce(hidden, 0) AS hidden_below FROM q LEFT JOIN c ON c.entity = focus LEFT JOIN n ON n.focus = q.focus""")
def ego_figures(spark, d):
    """Of each asked entity whether it is known, its items, and its neighbours shown, above and below the floor."""
    m = mentions(spark, d)
    asked = spark.createDataFrame([("Brand#11",), ("no such entity",), ("Brand#23",)], "focus string")
    counts = m.groupBy("entity").agg(F.count("*").alias("items"))
    mine = m.join(F.broadcast(asked), F.col("entity") == F.col("focus")).select("focus", "item_key")
    shared = m.join(mine, "item_key").where(F.col("entity") != F.col("focus")).select("focus", "entity").distinct().join(counts, "entity")
    n = shared.groupBy("focus").agg(F.count_if(F.col("items") >= FLOOR).alias("above"), F.count_if(F.col("items") < FLOOR).alias("hidden"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = asked.join(counts, F.col("entity") == F.col("focus"), "left").join(n, "focus", "left")
    return out.select("focus", F.col("entity").isNotNull().alias("known"), zero("items").alias("item_count"), F.least(F.lit(NEIGHBOURS), zero("above")).alias("shown"), zero("above").alias("above_threshold"), zero("hidden").alias("hidden_below"))


@query("""WITH t AS (SELECT 'text' AS v, count(*) AS total, count(*) FILTER (doc_id % 2 = 0) AS done FROM documents UNION ALL SELECT 'next', count(*), count(*) FILTER (doc_id % 10 = 0) FROM documents) SELECT v AS ruleset_version, total, done, total - done AS remaining FROM t""")
def version_coverage(spark, d):
    """How far each version of the rules has come, from its ledger rows."""
    docs = table(spark, d, "documents").select("doc_id")
    ledger = docs.where("doc_id % 2 = 0").withColumn("v", F.lit("text")).union(docs.where("doc_id % 10 = 0").withColumn("v", F.lit("next")))
    wanted = spark.createDataFrame([("text",), ("next",)], "v string")
    total = docs.agg(F.count("*").alias("total"))
    done = wanted.join(ledger.groupBy("v").agg(F.count("*").alias("done")), "v", "left")
    return done.withColumn("total", total.scalar()).select(F.col("v").alias("ruleset_version"), "total", F.coalesce("done", F.lit(0)).alias("done"), (F.col("total") - F.coalesce("done", F.lit(0))).alias("remaining"))


@query(f"""WITH s AS (SELECT DISTINCT user_id AS repo_id, ts::DATE AS day FROM events WHERE ts::DATE BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'), r AS (SELECT DISTINCT user_id AS repo_id FROM events), e AS (SELECT repo_id, unnest(generate_series(DATE '2024-01-22', DATE '2024-01-28', INTERVAL 1 DAY))::DATE AS day FROM r)
      SELECT e.repo_id, string_agg(CASE WHEN s.day IS NULL THEN e.day::VARCHAR END, ',' ORDER BY e.day) AS missing_days, count(s.day) AS observed FROM e LEFT JOIN s ON s.repo_id = e.repo_id AND s.day = e.day GROUP BY 1""")
def missing_days(spark, d):
    """Days of the window without a reading, by repository."""
    first, last = F.lit("2024-01-22").cast("date"), F.lit("2024-01-28").cast("date")
    day = F.to_date("ts")
    seen = table(spark, d, "events").groupBy(F.col("user_id").alias("repo_id")).agg(F.collect_set(F.when(day.between(first, last), day)).alias("days"))
    lost = F.array_sort(F.array_except(F.sequence(first, last), "days"))
    return seen.select("repo_id", F.when(F.size(lost) > 0, F.array_join(F.transform(lost, lambda x: x.cast("string")), ",")).alias("missing_days"), F.size("days").cast("long").alias("observed"))


VELOCITY_FULL = """k AS (SELECT c_custkey AS item_key FROM customer), s AS (SELECT user_id AS repo_id, ts::DATE AS day, max(ts) AS seen, arg_max(value, (ts, event_id)) AS stars, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1, 2),
    w AS (SELECT repo_id, count(*) AS n, min(seen) AS t0, max(seen) AS t1, max(day) AS d1, arg_min(stars, day) AS s0, arg_max(stars, day) AS s1, count(DISTINCT id % 2) > 1 AS mixed FROM s WHERE day BETWEEN DATE '2024-01-22' AND DATE '2024-01-28' GROUP BY 1),
    v AS (SELECT k.item_key, r.repo_id IS NOT NULL AS known, w.*, (epoch_us(t1) - epoch_us(t0)) / 86400e6 AS span FROM k LEFT JOIN (SELECT DISTINCT repo_id FROM s) r ON r.repo_id = k.item_key LEFT JOIN w ON w.repo_id = k.item_key)"""


@query(f"""WITH {VELOCITY_FULL}, o AS (SELECT *, CASE WHEN NOT known THEN 'unknown_repo' WHEN n IS NULL THEN 'no_snapshots' WHEN n = 1 THEN 'single_snapshot' WHEN span < 3 THEN 'span_too_short' ELSE 'ok' END AS status FROM v)
      SELECT item_key, status, CASE WHEN status = 'ok' THEN round((s1 - s0) / span, 6) END AS stars_per_day, CASE WHEN status = 'ok' THEN round(least(1, span / 6), 6) END AS span_coverage, CASE WHEN status = 'ok' THEN (DATE '2024-01-28' - d1)::INTEGER END AS stale_days, CASE WHEN status = 'ok' THEN mixed END AS mixed_timezone FROM o""")
def velocity_by_item(spark, d):
    """Growth between the first and the last reading of the window, by instants, or why there is none; days since the last reading; whether two zones met."""
    last = F.lit("2024-01-28").cast("date")
    ok = lambda c: F.when(F.col("status") == "ok", c)
    rate, cover = (F.col("s1") - F.col("s0")) / F.col("span"), F.least(F.lit(1.0), F.col("span") / 6)
    return velocity_rows(spark, d).select("item_key", "status", ok(F.round(rate, 6)).alias("stars_per_day"), ok(F.round(cover, 6)).alias("span_coverage"), ok(F.datediff(last, "d1")).alias("stale_days"), ok(F.col("mixed")).alias("mixed_timezone"))


def velocity_rows(spark, d):
    """Each item's first and last reading of the window, the days between, and whether that makes a growth."""
    first, last = F.lit("2024-01-22").cast("date"), F.lit("2024-01-28").cast("date")
    snaps = newest(table(spark, d, "events").select(F.col("user_id").alias("repo_id"), F.to_date("ts").alias("day"), F.col("ts").alias("at"), "event_id", F.col("value").alias("stars")), ["repo_id", "day"], "at", "event_id")
    w = snaps.where(F.col("day").between(first, last)).groupBy("repo_id").agg(F.count("*").alias("n"), F.min("at").alias("t0"), F.max("at").alias("t1"), F.max("day").alias("d1"), F.min_by("stars", "day").alias("s0"), F.max_by("stars", "day").alias("s1"), (F.count_distinct(F.col("event_id") % 2) > 1).alias("mixed"))
    known = snaps.select(F.col("repo_id").alias("item_key")).distinct().withColumn("known", F.lit(True))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("item_key")).join(known, "item_key", "left").join(w, F.col("item_key") == F.col("repo_id"), "left")
    span = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 86400e6
    status = F.when(F.col("known").isNull(), "unknown_repo").when(F.col("n").isNull(), "no_snapshots").when(F.col("n") == 1, "single_snapshot").when(span < 3, "span_too_short").otherwise("ok")
    return rows.withColumns({"status": status, "span": span})


@query(f"""WITH {VELOCITY_FULL}, g AS (SELECT item_key, known, CASE WHEN n > 1 AND span >= 3 THEN sign((s1 - s0) / span) * log2(1 + abs((s1 - s0) / span)) * least(1, span / 6) ELSE 0 END AS v FROM v),
      o AS (SELECT o_custkey AS k, count(*) AS n, max(CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0 END) AS h FROM orders GROUP BY 1),
      b AS (SELECT c_custkey AS item_key, c_mktsegment AS seg, known, g.v, coalesce(h, 0) AS h, greatest(0, least(1, log2(greatest(coalesce(o.n, 0), 1)) / 3)) AS c, greatest(0, least(1, (c_custkey % 20) * 0.1 / 1.9)) AS w,
                   greatest(0.05, least(3, 1 + 0.5 * (c_acctbal > 5000)::INT - 0.8 * (c_acctbal < 0)::INT)) AS m FROM customer JOIN g ON item_key = c_custkey LEFT JOIN o ON k = c_custkey)
      SELECT item_key, unnest(CASE WHEN known THEN ['repos', seg] ELSE [seg] END) AS beat, round(10 * (0.6 * c + 0.4 * w + CASE WHEN known THEN 0.2 * v - 0.1 * h ELSE 0 END) * m, 6)::DOUBLE AS signal_score,
             round(10 * (0.3 * c + 0.7 * w + CASE WHEN known THEN 0.1 * v - 0.2 * h ELSE 0 END) * m, 6)::DOUBLE AS read_score FROM b""")
def whole_scores(spark, d):
    """Every part of the score in one: cluster, source, growth from readings, discussion and interest; one row a beat, both profiles."""
    k = F.col("c_custkey")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max(F.when(F.col("o_orderkey") % 5 == 0, 1.0).when(F.col("o_orderkey") % 5 == 1, 0.6).otherwise(0.0)).alias("h"))
    rows = table(spark, d, "customer").join(velocity_rows(spark, d).withColumnRenamed("item_key", "c_custkey"), "c_custkey").join(orders, "c_custkey", "left")
    ok = F.col("status") == "ok"
    growth = F.when(ok, S.velocity((F.col("s1") - F.col("s0")) / F.col("span"), F.least(F.lit(1.0), F.col("span") / 6))).otherwise(0.0)
    repo = F.coalesce("known", F.lit(False))
    parts = [S.cluster_size(F.coalesce("n_orders", F.lit(0))), S.source_weight(0.1 + (k % 20) * 0.1), repo, growth, F.coalesce("h", F.lit(0.0)), S.interest_multiplier((F.col("c_acctbal") > 5000).cast("int"), (F.col("c_acctbal") < 0).cast("int"))]
    beats = F.when(repo, F.array(F.lit("repos"), F.col("c_mktsegment"))).otherwise(F.array("c_mktsegment"))
    return rows.select(k.alias("item_key"), F.explode(beats).alias("beat"), *[S.mechanical(p, *parts).alias(f"{p}_score") for p in S.PROFILES])


#: Words that are no terms (fixed values).
TERM_STOP = [
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "is", "as", "by", "with", "from", "into", "after", "over", "amid", "its", "it", "be", "are", "was", "were", "that",
    "this", "these", "those", "but", "or", "not", "no", "up", "down", "out", "about", "than", "then", "so", "says", "said", "new", "will", "would", "can", "could", "should", "just",
    "one", "two", "more", "most", "some", "all", "each", "per", "off", "vs", "you", "your", "we", "our", "they", "their", "he", "she", "his", "her", "has", "have", "had", "us", "how",
    "what", "why", "who", "when", "where", "which", "amp", "via", "also", "now", "here", "there", "if", "do", "does", "did", "been", "being", "i", "am", "against",
]
#: Terms that say nothing about a topic by themselves (fixed values).
AMBIGUOUS = ["crypto", "opinion", "editorial", "ai powered", "top 10"]
#: Terms of the profile, which need no proposal.
KNOWN_TERMS = ["ha"]
TERMS_OF = """list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"""
MINED_SQL = f"""w AS (SELECT doc_id, {TERMS_OF} AS w FROM documents), u AS (SELECT doc_id, list_distinct(list_filter(w, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]{{4}}$') AND x NOT IN ({", ".join(f"'{x}'" for x in TERM_STOP)}))
      || list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN length(w[i]) >= 2 AND length(w[i + 1]) >= 2 AND NOT regexp_matches(w[i], '^[0-9]{{4}}$') AND NOT regexp_matches(w[i + 1], '^[0-9]{{4}}$') AND w[i] NOT IN ({", ".join(f"'{x}'" for x in TERM_STOP)}) AND w[i + 1] NOT IN ({", ".join(f"'{x}'" for x in TERM_STOP)}) THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL)) AS terms FROM w),
    t AS (SELECT doc_id, unnest(terms) AS term FROM u), k AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'suppress' WHEN quality = 0 THEN 'boost' ELSE 'rest' END AS side FROM labels)"""


def candidate_terms(title):
    """Lower-case words and pairs of neighbours, without short and stop words and years, each once."""
    good = lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]{4}$") & ~w.isin(*TERM_STOP)
    words = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def both(w):
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(good(a) & good(b), F.concat_ws(" ", a, b)))
        return F.array_distinct(F.concat(F.filter(w, good), F.array_compact(pairs)))

    return F.get(F.transform(F.array(words), both), F.lit(0))


FORM_SQL = """' ' || trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_\\s-]+', ' ' || chr(1) || ' ', 'g'), '[\\s-]+', ' ', 'g')) || ' '"""


@query(f"""WITH {MINED_SQL}, n AS (SELECT count(*) AS all_, count(*) FILTER (side = 'boost') AS nb, count(*) FILTER (side = 'suppress') AS ns FROM k),
      m AS (SELECT t.doc_id, term, side, split_part(text, chr(10), 1) AS title FROM t JOIN k ON k.doc_id = t.doc_id JOIN documents d ON d.doc_id = t.doc_id WHERE contains({FORM_SQL}, ' ' || term || ' ') AND term NOT IN ({", ".join(f"'{x}'" for x in AMBIGUOUS + KNOWN_TERMS)})),
      c AS (SELECT term, count(*) AS df, count(*) FILTER (side = 'boost') AS xb, count(*) FILTER (side = 'suppress') AS xs FROM m GROUP BY 1),
      z AS (SELECT term, df, unnest(['boost', 'suppress']) AS side, unnest([xb, xs]) AS x, unnest([nb, ns]) AS n, all_ FROM c, n),
      y AS (SELECT term, side, x AS in_class, df - x AS in_rest, round((ln((x + 0.5) / (n - x + 0.5)) - ln((df - x + 0.5) / (all_ - n - (df - x) + 0.5))) / sqrt(1 / (x + 0.5) + 1 / (n - x + 0.5) + 1 / (df - x + 0.5) + 1 / (all_ - n - (df - x) + 0.5)), 6) AS z FROM z WHERE x >= 3 AND n >= 5),
      best AS (SELECT * FROM y WHERE z >= 1.96 QUALIFY row_number() OVER (PARTITION BY side ORDER BY z DESC, term) <= 20),
      e AS (SELECT best.side, best.term, title, row_number() OVER (PARTITION BY best.side, best.term ORDER BY m.doc_id) AS r FROM best JOIN m ON m.term = best.term AND m.side = best.side)
      SELECT side, term, in_class, in_rest, z, (SELECT string_agg(title, '; ' ORDER BY r) FROM e WHERE e.side = best.side AND e.term = best.term AND r <= 3) AS examples FROM best""")
def proposed_terms(spark, d):
    """Terms that set saved and dismissed titles apart from the rest, each with three titles of its class."""
    k = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "suppress").when(F.col("quality") == 0, "boost").otherwise("rest").alias("side"))
    titles = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title")).join(k, "doc_id").withColumnRenamed("doc_id", "item_key")
    return propose(titles, k, [*AMBIGUOUS, *KNOWN_TERMS])


#: Items of a class, items of a term, z, terms of a side and titles of a term (fixed values).
LEAST_CLASS, LEAST_TERM, LEAST_Z, MOST_TERMS, EXAMPLES = 5, 3, 1.96, 20, 3


def propose(titles, sides, excluded):
    """(side, term, in_class, in_rest, z, examples) from titles (item_key, title, side) and the sides of all items.

    Candidates are the terms of a class's titles; a title counts if it holds the term by the
    rule of term matching: its words in a row, parted by white space or hyphens alone. A
    class of fewer than 5 items proposes nothing.
    """
    n = sides.groupBy().agg(F.count("*").alias("all"), F.count_if(F.col("side") == "boost").alias("nb"), F.count_if(F.col("side") == "suppress").alias("ns"))
    form = F.concat(F.lit(" "), spaced(F.lower("title")), F.lit(" "))
    held = spread(titles).select("item_key", "title", "side", form.alias("form"), F.explode(candidate_terms(F.col("title"))).alias("term"))
    held = stored(held.where(F.contains("form", F.concat(F.lit(" "), "term", F.lit(" "))) & ~F.col("term").isin(*excluded)).drop("form"), "held-terms")
    c = held.groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("side") == "boost").alias("xb"), F.count_if(F.col("side") == "suppress").alias("xs")).where(f"df >= {LEAST_TERM}")
    one = lambda side, x, size: F.struct(F.lit(side).alias("side"), F.col(x).alias("x"), F.col(size).alias("n"))
    both = c.withColumns({name: n.select(name).scalar() for name in ("all", "nb", "ns")}).select("term", "df", "all", F.inline(F.array(one("boost", "xb", "nb"), one("suppress", "xs", "ns"))))
    both = both.where((F.col("x") >= LEAST_TERM) & (F.col("n") >= LEAST_CLASS))
    z = both.withColumn("z", F.round(log_odds_z(F.col("x"), F.col("n"), F.col("df") - F.col("x"), F.col("all") - F.col("n")), 6)).where(F.col("z") >= LEAST_Z)
    top = Window.partitionBy("side").orderBy(F.desc("z"), "term")
    told = z.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= MOST_TERMS).select("side", "term", F.col("x").alias("in_class"), (F.col("df") - F.col("x")).alias("in_rest"), "z")
    first = Window.partitionBy("side", "term").orderBy("item_key")
    shown = held.join(F.broadcast(told.select("side", "term")), ["side", "term"]).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= EXAMPLES)
    shown = shown.groupBy("side", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]), "; ").alias("examples"))
    return told.join(shown, ["side", "term"])


@query(f"""WITH {RANK_SQL}, b AS (SELECT beat, count(*) AS ranked, count(*) FILTER (pinned) AS flagged FROM f GROUP BY 1), t AS (SELECT beat, item_key, decayed, row_number() OVER (PARTITION BY beat ORDER BY decayed DESC, item_key) AS n FROM f WHERE NOT pinned),
      once AS (SELECT item_key, min(priority) AS priority, max(computed_at) AS seen FROM f WHERE pinned GROUP BY 1 ORDER BY priority, seen DESC NULLS LAST, item_key DESC LIMIT 50)
      SELECT 'beat' AS part, beat AS name, NULL::BIGINT AS item_key, '## ' || beat || ': ' || ranked || ' ranked, ' || flagged || ' flagged' AS line FROM b UNION ALL SELECT 'top', beat, item_key, '- [item ' || item_key || '](https://items.example/' || item_key || ')' FROM t WHERE n <= 5
      UNION ALL SELECT 'pinned', NULL, item_key, '- **[item ' || item_key || '](https://items.example/' || item_key || ')** (' || priority || ')' FROM once""")
def digest_rows(spark, d):
    """The lines of a daily note: coverage by beat, the five strongest unpinned of each, and each pinned item once across beats."""
    f = ranked(spark, d)
    link = F.concat(F.lit("[item "), "item_key", F.lit("](https://items.example/"), "item_key", F.lit(")"))
    heads = f.groupBy("beat").agg(F.count("*").alias("r"), F.count_if("pinned").alias("p")).select(F.lit("beat").alias("part"), F.col("beat").alias("name"), F.lit(None).cast("long").alias("item_key"), F.concat(F.lit("## "), "beat", F.lit(": "), "r", F.lit(" ranked, "), "p", F.lit(" flagged")).alias("line"))
    w = Window.partitionBy("beat").orderBy(F.desc("decayed"), "item_key")
    top = f.where("not pinned").withColumn("n", F.row_number().over(w)).where("n <= 5").select(F.lit("top"), "beat", "item_key", F.concat(F.lit("- "), link))
    once = f.where("pinned").groupBy("item_key").agg(F.min("priority").alias("priority"), F.max("computed_at").alias("at")).orderBy("priority", F.desc_nulls_last("at"), F.desc("item_key")).limit(50)
    return heads.union(top).union(once.select(F.lit("pinned"), F.lit(None).cast("string"), "item_key", F.concat(F.lit("- **"), link, F.lit("** ("), "priority", F.lit(")"))))


@query(f"""WITH l AS (SELECT o_custkey AS item_key, CASE WHEN o_custkey % 13 = 0 THEN 'markets' ELSE o_orderpriority END AS beat, CASE WHEN o_custkey % 2 = 0 THEN 'event' ELSE 'press' END AS item_type, CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END AS published_at, TIMESTAMP '1998-01-01' AS first_fetched_at, o_totalprice AS score FROM orders)
      SELECT item_key, l.beat, round(sum(score * pow(0.5, greatest(0, epoch(TIMESTAMP '1998-08-02') - epoch(coalesce(published_at, first_fetched_at))) / 3600 / coalesce(h.hl, CASE item_type WHEN 'event' THEN 48.0 ELSE 24.0 END))), 4) AS decayed FROM l LEFT JOIN {HALF_SQL} ON h.beat = l.beat WHERE h.hl IS NOT NULL OR l.beat = 'markets' GROUP BY 1, 2""")
def decayed_by_type(spark, d):
    """Decay from the publication, else from the first fetch; half-lives by beat, by item type for markets; another beat is an error."""
    k = F.col("o_custkey")
    rows = table(spark, d, "orders").select(k.alias("item_key"), F.when(k % 13 == 0, "markets").otherwise(F.col("o_orderpriority")).alias("beat"), F.when(k % 2 == 0, "event").otherwise("press").alias("item_type"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("published_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("first_fetched_at"), F.col("o_totalprice").alias("score"))
    hours = half_life(F.col("beat"), F.col("item_type"))
    age = (F.unix_millis(F.lit("1998-08-02").cast("timestamp_ntz").cast("timestamp")) - F.unix_millis(F.coalesce("published_at", "first_fetched_at").cast("timestamp"))) / 3_600_000
    return rows.groupBy("item_key", "beat").agg(F.round(F.sum(F.col("score") * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / hours)), 4).alias("decayed"))


def half_life(beat, item_type):
    """Half-life in hours by beat, or by item type for markets; an unknown one is an error."""
    by_beat = F.create_map(*[F.lit(x) for kv in HALF_LIVES.items() for x in kv])
    by_type = F.create_map(F.lit("event"), F.lit(48.0), F.lit("press"), F.lit(24.0), F.lit("analysis"), F.lit(72.0))
    hours = F.when(beat == "markets", F.try_element_at(by_type, item_type)).otherwise(F.try_element_at(by_beat, beat))
    return F.coalesce(hours, F.raise_error(F.concat(F.lit("no half-life for "), beat)).cast("double"))


@query("""WITH i AS (SELECT c_custkey AS item_key, CASE WHEN c_nationkey <> 0 THEN c_mktsegment END AS kind, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS score, TIMESTAMP '2024-01-01' + to_hours((c_custkey % 100)::INTEGER) AS first_seen FROM customer),
      f AS (SELECT * FROM i WHERE kind IN ('BUILDING', 'MACHINERY') AND first_seen >= TIMESTAMP '2024-01-02') SELECT count(*) AS candidates, count(*) FILTER (score >= 1000) AS matched, count(*) FILTER (score IS NULL) AS unscored_excluded FROM f""")
def floor_counts(spark, d):
    """Rows after kind filter (unknown kinds match none), first-seen bound and score floor, with the unscored that the floor dropped."""
    k = F.col("c_custkey")
    i = table(spark, d, "customer").select(F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment")).alias("kind"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("score"), F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + (k % 100) * 3600).alias("first_seen"))
    f = i.where(F.col("kind").isin("BUILDING", "MACHINERY") & (F.col("first_seen") >= F.lit("2024-01-02").cast("timestamp")))
    return f.agg(F.count("*").alias("candidates"), F.count_if(F.col("score") >= 1000).alias("matched"), F.count_if(F.col("score").isNull()).alias("unscored_excluded"))


__all__ = ["T"]
