"""Current, point-in-time and state queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import versions as V
from tidewatch.plans import NOW, query
from tidewatch.session import table

AS_OF = "2024-01-15 12:00:00"


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as item versions."""
    return table(spark, d, "events").select(F.col("user_id").alias("item_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("ingest_seq"), F.col("event_type").alias("beat"), "value", "props")


@query("""SELECT user_id AS item_key, ts AS fetched_at, event_id AS ingest_seq, event_type AS beat, value, props FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def current_versions(spark, d):
    return V.current(versions(spark, d), ["item_key"])


@query(f"""SELECT user_id AS item_key, ts AS fetched_at, event_id AS ingest_seq, event_type AS beat, value, props FROM events
           WHERE ts <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def versions_as_of(spark, d):
    return V.as_of(versions(spark, d), ["item_key"], AS_OF, horizon="2024-01-01 00:00:00")


@query("SELECT user_id AS item_key, min(ts) AS first_seen, count(*) AS n_versions FROM events GROUP BY user_id")
def first_seen(spark, d):
    return versions(spark, d).groupBy("item_key").agg(F.min("fetched_at").alias("first_seen"), F.count("*").alias("n_versions"))


@query(f"""SELECT user_id AS item_key, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS beats FROM events
           WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id""")
def beats_union(spark, d):
    seen = versions(spark, d).where(F.col("fetched_at") <= F.lit(AS_OF).cast("timestamp"))
    return seen.groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_set("beat")), ",").alias("beats"))


@query("""WITH o AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
               n AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
          SELECT coalesce(o.user_id, n.user_id) AS item_key,
                 CASE WHEN o.ts IS NULL OR n.ts > o.ts THEN n.ts ELSE o.ts END AS fetched_at,
                 CASE WHEN o.ts IS NULL OR n.ts > o.ts THEN n.id ELSE o.id END AS ingest_seq,
                 CASE WHEN o.ts IS NULL THEN 'inserted' WHEN n.ts IS NULL THEN 'kept' WHEN n.ts > o.ts THEN 'updated' ELSE 'ignored' END AS action
          FROM o FULL JOIN n ON o.user_id = n.user_id""")
def upsert_if_newer(spark, d):
    v = versions(spark, d).select("item_key", "fetched_at", "ingest_seq")
    return V.upsert_if_newer(V.current(v.where("ingest_seq % 2 = 0"), ["item_key"]), v.where("ingest_seq % 2 = 1"), ["item_key"], "fetched_at")


ACTIONS = {"view": "read", "purchase": "save", "signup": "unsave", "error": "dismiss"}


def state_log(spark, d):
    """Events as user actions on items."""
    kind = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias("item_key"), "ts", F.col("event_id").alias("seq"), kind.alias("action")).where("action is not null")


STATE_SQL = """WITH c AS (SELECT user_id, max((ts, event_id)) AS cleared FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT e.user_id AS item_key, min(ts) FILTER (event_type = 'view') AS read_at,
           min(ts) FILTER (event_type = 'purchase' AND (c.cleared IS NULL OR (ts, event_id) > c.cleared)) AS saved_at,
           min(ts) FILTER (event_type = 'error') AS dismissed_at,
           (count(*) FILTER (event_type = 'error') > 0)::INTEGER AS signals
    FROM events e LEFT JOIN c ON e.user_id = c.user_id WHERE event_type IN ('view', 'purchase', 'signup', 'error') GROUP BY e.user_id"""


@query(STATE_SQL)
def item_state_replay(spark, d):
    return V.replay_state(state_log(spark, d))


@query(f"""WITH h AS (SELECT unnest(range(24)) AS hour_ago),
                c AS (SELECT floor((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 3600)::BIGINT AS hour_ago, count(*) AS n FROM events
                      WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1)
           SELECT h.hour_ago, coalesce(n, 0) AS n FROM h LEFT JOIN c ON h.hour_ago = c.hour_ago""")
def hourly_buckets(spark, d):
    age = (F.lit(NOW).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 3600
    counts = table(spark, d, "events").withColumn("hour_ago", F.floor(age)).where((age >= 0) & (age < 24)).groupBy("hour_ago").count()
    return spark.range(24).toDF("hour_ago").join(counts, "hour_ago", "left").select("hour_ago", F.coalesce("count", F.lit(0)).alias("n"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, arg_max(value, (ts, event_id)) AS stars, max(ts) AS observed_at FROM events GROUP BY 1, 2)
          SELECT user_id AS repo_id, day AS snapshot_day, stars, observed_at FROM s""")
def star_snapshots(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("repo_id"), F.to_date("ts").alias("snapshot_day"), F.col("value").alias("stars"), F.col("ts").alias("observed_at"), "event_id")
    return V.newest(v, ["repo_id", "snapshot_day"], "observed_at", "event_id").drop("event_id")


THROUGH, DAYS, LEAST_SPAN = "2024-01-28", 7, 3
VELOCITY_SQL = f"""s AS (SELECT user_id AS repo_id, ts::DATE AS day, arg_max(value, (ts, event_id)) AS stars FROM events GROUP BY 1, 2),
    r AS (SELECT DISTINCT repo_id FROM s),
    w AS (SELECT repo_id, count(*) AS n, min(day) AS d0, max(day) AS d1, arg_min(stars, day) AS s0, arg_max(stars, day) AS s1 FROM s
          WHERE day > DATE '{THROUGH}' - {DAYS} AND day <= DATE '{THROUGH}' GROUP BY 1),
    v AS (SELECT r.repo_id, CASE WHEN n IS NULL THEN 'no_snapshots' WHEN n = 1 THEN 'single_snapshot' WHEN d1 - d0 < {LEAST_SPAN} THEN 'span_too_short' ELSE 'ok' END AS status,
                 d1 - d0 AS span, n, s1 - s0 AS gain FROM r LEFT JOIN w ON r.repo_id = w.repo_id)"""


def velocity(spark, d):
    """Growth over the trailing window, or why there is none."""
    s = star_snapshots(spark, d)
    day = F.col("snapshot_day")
    w = s.where((day > F.date_sub(F.lit(THROUGH).cast("date"), DAYS)) & (day <= F.lit(THROUGH).cast("date")))
    w = w.groupBy("repo_id").agg(F.count("*").alias("n"), F.min(day).alias("d0"), F.max(day).alias("d1"), F.min_by("stars", day).alias("s0"), F.max_by("stars", day).alias("s1"))
    span = F.datediff("d1", "d0")
    status = F.when(F.col("n").isNull(), "no_snapshots").when(F.col("n") == 1, "single_snapshot").when(span < LEAST_SPAN, "span_too_short").otherwise("ok")
    return s.select("repo_id").distinct().join(w, "repo_id", "left").select("repo_id", status.alias("status"), span.alias("span"), "n", (F.col("s1") - F.col("s0")).alias("gain"))


@query(f"""WITH {VELOCITY_SQL} SELECT repo_id, status, CASE WHEN status = 'ok' THEN gain END AS gain, CASE WHEN status = 'ok' THEN round(gain / span, 6) END AS rate,
           CASE WHEN status = 'ok' THEN round((span + 1) / {DAYS}.0, 6) END AS coverage, CASE WHEN status = 'ok' THEN (span + 1 - n)::INTEGER END AS missing_days FROM v""")
def star_velocity(spark, d):
    ok = lambda c: F.when(F.col("status") == "ok", c)
    return velocity(spark, d).select("repo_id", "status", ok(F.col("gain")).alias("gain"), ok(F.round(F.col("gain") / F.col("span"), 6)).alias("rate"), ok(F.round((F.col("span") + 1) / float(DAYS), 6)).alias("coverage"), ok((F.col("span") + 1 - F.col("n")).cast("int")).alias("missing_days"))


@query(f"""WITH {VELOCITY_SQL} SELECT repo_id, CASE WHEN status = 'ok' THEN
           round(sign(gain / span) * log2(1 + abs(gain / span)) * greatest(0.5, (span + 1) / {DAYS}.0), 6) ELSE 0.0 END AS component FROM v""")
def velocity_component(spark, d):
    rate = F.col("gain") / F.col("span")
    part = F.signum(rate) * F.log2(1 + F.abs(rate)) * F.greatest(F.lit(0.5), (F.col("span") + 1) / float(DAYS))
    return velocity(spark, d).select("repo_id", F.when(F.col("status") == "ok", F.round(part, 6)).otherwise(0.0).alias("component"))
