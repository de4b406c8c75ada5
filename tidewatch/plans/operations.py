"""Source health, usage, caches, work lists, reconciliation, quality and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.plans import NOW, query
from tidewatch.plans.versions import STATE_SQL, state_log
from tidewatch.session import table
from tidewatch.streaming import state as S


@query(f"""WITH h AS (SELECT user_id AS source_id, max(ts) FILTER (event_type <> 'error') AS ok_at, max(ts) FILTER (event_type = 'error') AS bad_at, count(*) AS attempts, count(*) FILTER (event_type <> 'error' AND ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS yield_7d FROM events GROUP BY 1)
           SELECT source_id, attempts, yield_7d, CASE WHEN ok_at IS NULL THEN 'never' WHEN bad_at > ok_at THEN 'failing' WHEN ok_at < TIMESTAMP '{NOW}' - INTERVAL 36 HOUR THEN 'stale' ELSE 'healthy' END AS status FROM h""")
def source_health(spark, d):
    ok, now = F.col("event_type") != "error", F.lit(NOW).cast("timestamp_ntz")
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max(F.when(ok, F.col("ts"))).alias("ok_at"), F.max(F.when(~ok, F.col("ts"))).alias("bad_at"), F.count("*").alias("attempts"), F.count_if(ok & (F.col("ts") > now - F.expr("interval 7 days"))).alias("yield_7d"))
    status = F.when(F.col("ok_at").isNull(), "never").when(F.col("bad_at") > F.col("ok_at"), "failing").when(F.col("ok_at") < now - F.expr("interval 36 hours"), "stale").otherwise("healthy")
    return h.select("source_id", "attempts", "yield_7d", status.alias("status"))


@query("""SELECT ts::DATE AS day, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS unavailable, round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS tokens, count(*) FILTER (event_type = 'view') AS unmetered FROM events GROUP BY 1""")
def call_usage_daily(spark, d):
    ok = F.col("event_type") != "error"
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("unavailable"), F.round(F.sum(F.when(ok, F.col("value"))), 4).alias("tokens"), F.count_if(F.col("event_type") == "view").alias("unmetered"))


@query("SELECT ts::DATE AS day, event_type AS status, count(*) AS n, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1, 2")
def call_reachability(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""WITH u AS (SELECT ts::DATE AS day, sum(value) AS used FROM events WHERE event_type <> 'error' GROUP BY 1)
          SELECT day, CASE WHEN used < 15000 THEN 'open' ELSE 'closed' END AS gate, round(greatest(0, 15000 - used), 4) AS remaining FROM u""")
def token_ceiling(spark, d):
    u = table(spark, d, "events").where("event_type <> 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("used"))
    return u.select("day", F.when(F.col("used") < 15000, "open").otherwise("closed").alias("gate"), F.round(F.greatest(F.lit(0.0), 15000 - F.col("used")), 4).alias("remaining"))


@query("""WITH r AS (SELECT event_id, sha256(octet_length(event_type::BLOB) || ':' || event_type || '|' || octet_length(user_id::VARCHAR::BLOB) || ':' || user_id) AS k, value, ts::DATE AS day FROM events WHERE event_id % 2 = 1),
      c AS (SELECT DISTINCT sha256(octet_length(event_type::BLOB) || ':' || event_type || '|' || octet_length(user_id::VARCHAR::BLOB) || ':' || user_id) AS k FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0),
      m AS (SELECT r.event_id, r.k, c.k IS NOT NULL AS hit, sum(CASE WHEN c.k IS NULL THEN value ELSE 0 END) OVER (PARTITION BY day ORDER BY event_id) AS used FROM r LEFT JOIN c ON r.k = c.k)
      SELECT event_id, k AS cache_key, CASE WHEN hit THEN 'hit' WHEN round(used, 9) <= 1000 THEN 'admitted' ELSE 'deferred' END AS outcome FROM m""")
def cache_split(spark, d):
    part = lambda c: F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    e = table(spark, d, "events").withColumn("k", F.sha2(F.concat_ws("|", part(F.col("event_type")), part(F.col("user_id"))), 256))
    known = e.where("event_id % 2 = 0 and user_id % 3 <> 0").select("k").distinct().withColumn("hit", F.lit(True))
    m = e.where("event_id % 2 = 1").join(known, "k", "left").withColumn("day", F.to_date("ts"))
    # running sums by block of ids, then what the blocks before hold: no task has a whole day
    m = m.withColumns({"block": F.floor(F.col("event_id") / 1000), "cost": F.when(F.col("hit").isNull(), F.col("value")).otherwise(0.0)})
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    blocks = m.groupBy("day", "block").agg(F.sum("cost").alias("all"))
    blocks = blocks.withColumn("before", F.sum("all").over(upto("day").orderBy("block")) - F.col("all")).drop("all")
    m = m.join(blocks, ["day", "block"])
    used = F.round(F.col("before") + F.sum("cost").over(upto("day", "block").orderBy("event_id")), 9)
    return m.withColumn("used", used).select("event_id", F.col("k").alias("cache_key"), F.when(F.col("hit"), "hit").when(F.col("used") <= 1000, "admitted").otherwise("deferred").alias("outcome"))


@query("""WITH a AS (SELECT c_custkey AS repo_id, max(o_orderdate) AS answered_at, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
      t AS (SELECT *, CASE WHEN answered_at IS NULL THEN 0 WHEN n < 3 THEN 1 WHEN answered_at < TIMESTAMP '1998-07-03' THEN 2 ELSE 3 END AS tier FROM a)
      SELECT repo_id, tier, row_number() OVER (ORDER BY tier, answered_at NULLS FIRST, repo_id)::INTEGER AS place FROM t ORDER BY place LIMIT 500""")
def readme_worklist(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo_id")).agg(F.max("o_orderdate").alias("answered_at"), F.count("*").alias("n"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id")).join(o, "repo_id", "left")
    tier = F.when(F.col("answered_at").isNull(), 0).when(F.col("n") < 3, 1).when(F.col("answered_at") < F.lit("1998-07-03").cast("timestamp_ntz"), 2).otherwise(3)
    order = ["tier", F.asc_nulls_first("answered_at"), "repo_id"]
    top = a.withColumn("tier", tier).orderBy(*order).limit(500)  # a bounded list, then numbered
    return top.select("repo_id", "tier", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 97 <> 0), l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey % 89 <> 0 GROUP BY 1)
          SELECT CASE WHEN o.k IS NULL THEN 'no order' WHEN l.k IS NULL THEN 'no lines' WHEN n > 6 THEN 'many lines' ELSE 'match' END AS reason, count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS n_lines FROM o FULL JOIN l ON o.k = l.k GROUP BY 1""")
def count_reconcile(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a"))
    n = table(spark, d, "lineitem").where("l_orderkey % 89 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    reason = F.when(F.col("a").isNull(), "no order").when(F.col("n").isNull(), "no lines").when(F.col("n") > 6, "many lines").otherwise("match")
    return o.join(n, "k", "full_outer").groupBy(reason.alias("reason")).agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))


@query("""WITH v AS (SELECT event_id, user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
          SELECT 'value falls by more than 90' AS rule, event_id AS key FROM v WHERE value < before - 90 UNION ALL SELECT 'value is tiny', event_id FROM v WHERE value < 0.5 UNION ALL SELECT 'bad payload', event_id FROM events WHERE NOT regexp_matches(props, '^\\{"k": [0-9]+\\}$')""")
def quality_violations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, d, "events").withColumn("before", F.lag("value").over(w))
    rules = {"value falls by more than 90": F.col("value") < F.col("before") - 90, "value is tiny": F.col("value") < 0.5, "bad payload": ~F.col("props").rlike(r'^\{"k": [0-9]+\}$')}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return v.select(F.explode(broken).alias("rule"), F.col("event_id").alias("key"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::DOUBLE AS threshold FROM events WHERE (props::JSON ->> '$.k')::DOUBLE >= 90""")
def json_thresholds(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return table(spark, d, "events").select("event_id", k.alias("threshold")).where("threshold >= 90")


@query("""WITH s AS (SELECT user_id AS repo_id, max(ts) AS seen_at, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS reads FROM events GROUP BY 1)
          SELECT repo_id, seen_at, array_to_string(list_filter([CASE WHEN errors > 15 THEN 'archived' END, CASE WHEN reads < 12 THEN 'no_readme' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def repo_rows(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("repo_id")).agg(F.max("ts").alias("seen_at"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("reads"))
    reasons = F.array_compact(F.array(F.when(F.col("errors") > 15, "archived"), F.when(F.col("reads") < 12, "no_readme")))
    return s.select("repo_id", "seen_at", F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT s_suppkey AS site_id, s_name AS name, n_name AS parent, count(l_orderkey) AS items FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def site_dimension(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("parent"))
    items = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("items"))
    s = table(spark, d, "supplier").join(n, "s_nationkey").join(items, "s_suppkey", "left")
    return s.select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"), "parent", F.coalesce("items", F.lit(0)).alias("items"))


def attempts(events):
    """Events as poll attempts."""
    return events.select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


SOURCE_SQL = """WITH l AS (SELECT user_id AS source_id, ts, event_id, event_type <> 'error' AS ok FROM events), m AS (SELECT source_id, max((ts, event_id)) FILTER (ok) AS s, max(ts) FILTER (ok) AS s_at, max(ts) FILTER (NOT ok) AS f_at FROM l GROUP BY 1),
    n AS (SELECT m.source_id, s_at, f_at, count(*) FILTER (NOT ok AND (s IS NULL OR (l.ts, l.event_id) > s)) AS n FROM m JOIN l ON m.source_id = l.source_id GROUP BY ALL)
    SELECT source_id, s_at AS last_success_at, f_at AS last_failure_at, n AS consecutive_failures, greatest(s_at, f_at) + to_milliseconds(((CASE WHEN n > 0 THEN least(pow(2.0, n), 6.0) ELSE 1.0 END) * 3600000)::BIGINT) AS next_eligible_at FROM n"""


@query(SOURCE_SQL)
def source_state_replay(spark, d):
    return S.replay_sources(attempts(table(spark, d, "events")))


def stream(spark, d):
    """The event table as a bounded stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


LATEST_SCHEMA = "item_key long, fetched_at timestamp_ntz, ingest_seq long, beat string, value double"


@query("""SELECT user_id AS item_key, ts AS fetched_at, event_id AS ingest_seq, event_type AS beat, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest(spark, d):
    v = stream(spark, d).select(F.col("user_id").alias("item_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("ingest_seq"), F.col("event_type").alias("beat"), "value")
    return S.drained(spark, v, lambda b, s: S.keep_latest(b, s, ["item_key"], ["fetched_at", "ingest_seq"]).select(*[c.split()[0] for c in LATEST_SCHEMA.split(", ")]), LATEST_SCHEMA)


@query(SOURCE_SQL)
def stream_source_state(spark, d):
    """One row a source as state: last success, last failure, failures since."""
    return S.next_polls(S.drained(spark, attempts(stream(spark, d)), S.fold_sources, S.SOURCE_STATE).withColumn("n", F.size("after")))


@query(STATE_SQL)
def stream_item_state(spark, d):
    """One row an item as state: first read, first save since it was cleared, first dismissal."""
    events = stream(spark, d)
    kind = F.create_map(*[F.lit(x) for x in ("view", "read", "purchase", "save", "signup", "unsave", "error", "dismiss")])[F.col("event_type")]
    log = events.select(F.col("user_id").alias("item_key"), "ts", F.col("event_id").alias("seq"), kind.alias("action")).where("action is not null")
    return S.item_states(S.drained(spark, log, S.fold_items, S.ITEM_STATE))


__all__ = ["state_log"]
