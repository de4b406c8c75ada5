"""Answers and work lists, integrity, search coverage, dictionary versions, names and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import names as N
from tidewatch.functions.text import first_line
from tidewatch.operators import quality as Q
from tidewatch.operators import versions as V
from tidewatch.plans import NOW, query
from tidewatch.plans.text import TERM_SQL, ZONE, matches
from tidewatch.session import table
from tidewatch.sources import feeds

ATTEMPT_SQL = """a AS (SELECT user_id * 31 + day(ts) AS repo_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'present' WHEN 'view' THEN 'absent' WHEN 'signup' THEN 'no_prose' END AS outcome,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'unreadable' END AS failure, CASE WHEN value >= 20 THEN props END AS item_key FROM events),
    r AS (SELECT repo_id, arg_max(outcome, (ts, seq)) FILTER (outcome IS NOT NULL) AS outcome, max(ts) FILTER (outcome IS NOT NULL) AS answered_at,
        arg_max({'f': failure}, (ts, seq)).f AS failure, max(ts) AS attempted_at, min(ts) AS first_attempted_at, arg_min(item_key, (ts, seq)) FILTER (item_key IS NOT NULL) AS item_key FROM a GROUP BY 1)"""


def readme_attempts(spark, d):
    """Events as attempts to read a file, a repository being a user's day."""
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "present", "view", "absent", "signup", "no_prose")])
    fails = F.create_map(*[F.lit(x) for x in ("error", "error", "click", "unreadable")])
    kind = F.col("event_type")
    return table(spark, d, "events").select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("repo_id"), "ts", F.col("event_id").alias("seq"), kinds[kind].alias("outcome"), fails[kind].alias("failure"), F.when(F.col("value") >= 20, F.col("props")).alias("item_key"))


@query(f"WITH {ATTEMPT_SQL} SELECT * FROM r")
def readme_answers(spark, d):
    return V.keep_answers(readme_attempts(spark, d), ["repo_id"], "ts", "seq", answer=["outcome"], attempt=["failure"], first=["item_key"])


@query(f"""WITH {ATTEMPT_SQL}, t AS (SELECT c_custkey AS repo_id, floor(c_acctbal)::BIGINT AS stars, attempted_at, answered_at,
        CASE WHEN attempted_at IS NULL THEN 0 WHEN outcome IS NULL THEN 1 WHEN answered_at > TIMESTAMP '{NOW}' - (CASE outcome WHEN 'present' THEN INTERVAL 30 DAY ELSE INTERVAL 24 HOUR END) THEN 3 ELSE 2 END AS tier
        FROM customer LEFT JOIN r ON c_custkey = repo_id)
    SELECT repo_id, tier, row_number() OVER (ORDER BY tier, CASE tier WHEN 1 THEN attempted_at WHEN 2 THEN answered_at END, CASE WHEN tier IN (0, 3) THEN stars END DESC, repo_id)::INTEGER AS place FROM t ORDER BY place LIMIT 500""")
def readme_tiers(spark, d):
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.floor("c_acctbal").alias("stars"))
    top = V.worklist(repos, readme_answers(spark, d), "repo_id", NOW, 500)
    waited = F.when(F.col("tier") == 1, F.col("attempted_at")).when(F.col("tier") == 2, F.col("answered_at"))
    order = Window.orderBy("tier", waited, F.when(F.col("tier").isin(0, 3), F.col("stars")).desc(), "repo_id")  # over the short list
    return top.select("repo_id", "tier", F.row_number().over(order).alias("place"))


@query(f"""WITH {ATTEMPT_SQL}, h AS (SELECT *, lag(ts) OVER w AS before, lag(outcome) OVER w AS was FROM a WINDOW w AS (PARTITION BY repo_id ORDER BY seq))
    SELECT 'attempt not later' AS rule, seq AS key FROM h WHERE ts <= before UNION ALL SELECT 'answer lost', seq FROM h WHERE outcome IS NULL AND was IS NOT NULL""")
def answer_violations(spark, d):
    return Q.answer_violations(readme_attempts(spark, d).withColumnRenamed("ts", "attempted_at"), ["repo_id"], "seq")


CALL_SQL = """c AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN value < 5 THEN 'Z' ELSE strftime(ts, '.%gZ') END AS called_at,
        ts::DATE + CASE WHEN value BETWEEN 5 AND 8 THEN 3 WHEN value BETWEEN 8 AND 10 THEN -3 ELSE 0 END AS usage_day, CASE event_type WHEN 'error' THEN 'unavailable' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' OR value BETWEEN 10 AND 12 THEN 'timeout' END AS reason, (props::JSON ->> '$.k')::BIGINT AS tin, CASE WHEN event_type <> 'view' THEN floor(value)::BIGINT END AS tout,
        event_type <> 'view' OR value > 80 AS counted, CASE WHEN event_type <> 'click' THEN value END AS amount, event_type <> 'click' OR value > 90 AS measured FROM events),
    k AS (SELECT *, CASE WHEN counted THEN coalesce(tin, 0) + coalesce(tout, 0) + CASE WHEN value_odd THEN 1 ELSE 0 END END AS total FROM (SELECT *, tout BETWEEN 30 AND 31 AS value_odd FROM c))"""


def calls(spark, d):
    """Events as a log of model calls; low and high values stand for faulty records."""
    e, value, kind = table(spark, d, "events"), F.col("value"), F.col("event_type")
    day = F.to_date("ts")
    k = F.get_json_object("props", "$.k").cast("long")
    late = F.when(value.between(5, 8), F.date_add(day, 3)).when(value.between(8, 10), F.date_sub(day, 3)).otherwise(day)
    rows = e.select(
        "event_id",
        F.concat(F.when(value < 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")), F.lit("Z")).alias("called_at"),
        late.alias("usage_day"),
        F.when(kind == "error", "unavailable").otherwise("ok").alias("status"),
        F.when((kind == "error") | value.between(10, 12), "timeout").alias("unavailable_reason"),
        k.alias("input_tokens"),
        F.when(kind != "view", F.floor("value")).alias("output_tokens"),
        ((kind != "view") | (value > 80)).alias("tokens_counted"),
        F.when(kind != "click", value).alias("amount_usd"),
        ((kind != "click") | (value > 90)).alias("cost_measured"),
    )
    out = F.col("output_tokens")
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce(out, F.lit(0)) + F.when(out.between(30, 31), 1).otherwise(0)
    return rows.withColumn("total_tokens", F.when(F.col("tokens_counted"), total))


@query(f"""WITH {CALL_SQL}
    SELECT 'instant not canonical' AS rule, event_id AS key FROM k WHERE NOT regexp_matches(called_at, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{{3}}Z$')
    UNION ALL SELECT 'day not plausible', event_id FROM k WHERE date_trunc('second', ts) - usage_day::TIMESTAMP <= -INTERVAL 1 DAY OR date_trunc('second', ts) - usage_day::TIMESTAMP >= INTERVAL 2 DAY
    UNION ALL SELECT 'reason against status', event_id FROM k WHERE (reason IS NULL) <> (status = 'ok')
    UNION ALL SELECT 'counted flag', event_id FROM k WHERE counted <> (tin IS NOT NULL AND tout IS NOT NULL)
    UNION ALL SELECT 'total against count', event_id FROM k WHERE (total IS NULL) = counted
    UNION ALL SELECT 'total is not the sum', event_id FROM k WHERE total <> tin + tout
    UNION ALL SELECT 'amount against measure', event_id FROM k WHERE (amount IS NULL) = measured""")
def call_violations(spark, d):
    return Q.violations(calls(spark, d), "event_id", Q.call_rules())


PAGE_SQL = """q AS (SELECT c_mktsegment AS topic, 1 AS request, c_custkey AS id, c_nationkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_mktsegment, 2, c_custkey, c_nationkey FROM customer WHERE c_acctbal < 5000),
    p AS (SELECT *, id // 30 AS page FROM q), g AS (SELECT * FROM p WHERE (page + request) % 7 > 0),
    f AS (SELECT topic, id, min(request) AS request, min(c_nationkey) IN (0, 1) AS unlike FROM g GROUP BY 1, 2)"""


def search_pages(spark, d):
    """(plan, pages): customers as repositories, a page for every 30 ids; one page in seven fails."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("topic"), F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    rows = c.where("c_acctbal > 0").withColumn("request", F.lit(1)).unionByName(c.where("c_acctbal < 5000").withColumn("request", F.lit(2)))
    item = F.struct("id", (F.col("c_nationkey") == 0).alias("fork"), (F.col("c_nationkey") == 1).alias("archived"))
    pages = rows.withColumn("page", F.floor(F.col("id") / 30)).groupBy("topic", "request", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    plan = pages.groupBy("topic", "request").agg(F.count("*").alias("planned"), F.sum(F.size("items")).alias("reported"))
    return plan, pages.where((F.col("page") + F.col("request")) % 7 > 0)


@query(f"WITH {PAGE_SQL} SELECT topic, request, id FROM f WHERE NOT unlike")
def search_items(spark, d):
    return feeds.search_union(search_pages(spark, d)[1]).where("not fork and not archived").select("topic", "request", "id")


@query(f"""WITH {PAGE_SQL}, x AS (SELECT topic, count(DISTINCT (request, page)) AS planned, count(*) AS reported FROM p GROUP BY 1), y AS (SELECT topic, count(DISTINCT (request, page)) AS completed, count(*) AS retrieved FROM g GROUP BY 1),
    z AS (SELECT topic, count(*) AS ids, count(*) FILTER (unlike) AS filtered FROM f GROUP BY 1)
    SELECT topic, planned, coalesce(completed, 0) AS completed, reported, coalesce(retrieved, 0) AS retrieved, coalesce(retrieved - ids, 0) AS repeated, coalesce(filtered, 0) AS filtered, coalesce(ids - filtered, 0) AS kept FROM x LEFT JOIN y USING (topic) LEFT JOIN z USING (topic)""")
def search_coverage(spark, d):
    return feeds.search_coverage(*search_pages(spark, d))


@query("""WITH t AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT p_brand AS dictionary, count(*) AS terms, left(sha256(string_agg(strlen(p_type) || ':' || p_type, '|' ORDER BY p_type)), 16) AS version FROM t GROUP BY 1""")
def dictionary_versions(spark, d):
    """A dictionary's version follows from its distinct terms, whatever their order; a dictionary's size is bounded by its authors."""
    part = F.concat(F.octet_length("p_type").cast("string"), F.lit(":"), F.col("p_type"))
    t = table(spark, d, "part").select("p_brand", "p_type").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p_type", part.alias("s")))), lambda x: x["s"])
    return t.groupBy(F.col("p_brand").alias("dictionary")).agg(F.count("*").alias("terms"), F.substring(F.sha2(F.array_join(ordered, "|"), 256), 1, 16).alias("version"))


PARTS_SQL = "o AS (SELECT doc_id AS item_key, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS excerpt, text FROM documents)"
STRIP_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[#A-Za-z0-9]+;', ' ', 'g'), '\s+', ' ', 'g'))"
CONTENT_SQL = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in N.CONTENT_STOP) + ")))"


@query(f"""WITH {PARTS_SQL}, b AS (SELECT item_key, {STRIP_SQL.format('text')} AS body, {CONTENT_SQL.format(STRIP_SQL.format('excerpt'))} AS e, {CONTENT_SQL.format('title')} AS t FROM o),
    n AS (SELECT item_key, length(body) AS size, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))::INTEGER AS words, len(list_filter(e, lambda w: NOT list_contains(t, w)))::INTEGER AS novel FROM b)
    SELECT item_key, words, novel, CASE WHEN words >= 400 THEN 'body' WHEN novel >= 8 THEN 'excerpt' ELSE 'headline' END AS level, CASE WHEN words >= 400 THEN greatest(1, round(words / 200.0))::INTEGER END AS minutes, words >= 400 AND size > 6000 AS truncated FROM n""")
def blurb_evidence(spark, d):
    parts = table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), N.evidence(first_line(F.col("text")), F.split_part("text", F.lit("\n"), F.lit(2)), F.col("text")).alias("e"))
    return parts.select("item_key", "e.*")


@query(f"""WITH s AS (SELECT doc_id, TIMESTAMP '{NOW}' - to_hours(doc_id % 1000) AS saved_at, trim(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^a-z0-9]+', '-', 'g'), '-') AS w FROM documents),
    c AS (SELECT *, CASE WHEN length(w) <= 80 THEN w WHEN contains(left(w, 80), '-') THEN regexp_extract(left(w, 80), '^(.+)-[^-]*$', 1) ELSE left(w, 80) END AS cut FROM s)
    SELECT doc_id, 'saved/' || strftime(saved_at AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m-%d') || '-' || CASE WHEN cut = '' THEN 'untitled' ELSE cut END || '-' || left(sha256(doc_id::VARCHAR), 12) || '.md' AS path FROM c""")
def note_paths(spark, d):
    docs = table(spark, d, "documents")
    saved = F.lit(NOW).cast("timestamp_ntz") - F.make_interval(hours=(F.col("doc_id") % 1000).cast("int"))
    return docs.select("doc_id", N.note_path(saved, first_line(F.col("text")), F.sha2(F.col("doc_id").cast("string"), 256), ZONE).alias("path"))


@query(r"""WITH n AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN left(split_part(text, chr(10), 1), 40) ELSE split_part(text, chr(10), 1) END AS name FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(name, '^[\t-\r\p{Z}\x{FEFF}]*$') THEN 'empty' WHEN contains(name, '/') OR contains(name, '\') THEN 'separator' WHEN regexp_matches(name, '^[\t-\r\p{Z}\x{FEFF}]|[\t-\r\p{Z}\x{FEFF}]$') THEN 'whitespace_edge'
      WHEN regexp_matches(name, '[\x00-\x1f\x7f]') THEN 'control_char' WHEN starts_with(name, '.') THEN 'dot_leading' WHEN regexp_matches(name, '[:*?"<>|\[\]#^]') THEN 'reserved_char' WHEN regexp_matches(name, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)') THEN 'device_name'
      WHEN strlen(name) > 197 THEN 'too_long' END AS reason FROM n""")
def name_reasons(spark, d):
    line = first_line(F.col("text"))
    name = F.when(F.col("n_chars") > 500, F.substring(line, 1, 40)).otherwise(line)
    return table(spark, d, "documents").select("doc_id", N.name_reason(name).alias("reason"))


@query("""SELECT page_id, '[' || replace(replace(regexp_replace(left(html, 60), '([\\\\\\[\\]])', '\\\\\\1', 'g'), '<', '&lt;'), '>', '&gt;') || '](<' || replace(replace(replace(url, ' ', '%20'), '<', '%3C'), '>', '%3E') || '>)' AS link FROM pages""")
def markdown_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("["), N.label(F.substring("html", 1, 60)), F.lit("](<"), N.target(F.col("url")), F.lit(">)")).alias("link"))


@query(f"""WITH m AS ({TERM_SQL}), g AS (SELECT item_key, list(term ORDER BY term) AS t FROM m GROUP BY 1) SELECT item_key, array_to_string(t[1:2], ', ') || CASE WHEN len(t) > 2 THEN ' +' || (len(t) - 2) || ' more' ELSE '' END AS terms FROM g""")
def term_lists(spark, d):
    """The matched terms of an item, two by name; the dictionary bounds the list."""
    return matches(spark, d).groupBy("item_key").agg(N.some_of(F.array_sort(F.collect_set("term")), 2).alias("terms"))
