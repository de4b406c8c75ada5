"""Entries as feeds give them: documents, payloads, dates, URLs, and their append as versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import text as T
from tidewatch.operators import versions as V
from tidewatch.plans import NOW, query
from tidewatch.session import scratch, spread, table
from tidewatch.sources import payloads as P
from tidewatch.sources import xml as X


def tag(name: str, text) -> F.col:
    """An XML element; null text gives no element."""
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name.split()[0]}>")), F.lit(""))


def grouped(rows, key: str, order: str, head: str, tail: str):
    """(key, body): the blocks of each key in order within one document."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]), "")
    return rows.groupBy(key).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("body"))


@query("""SELECT c_nationkey AS feed, 'https://feed.example/' || c_custkey AS url, c_name AS title, 'Mon, 01 Jan 2024 10:00:00 GMT' AS published_at,
             CASE WHEN c_custkey % 3 = 0 THEN 'content ' || c_mktsegment ELSE 'about ' || c_mktsegment END AS summary,
             CASE WHEN c_custkey % 4 = 0 THEN 'desk' ELSE 'creator ' || c_nationkey END AS author FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""")
def rss_items(spark, d):
    """Documents of many items: some without link or with a blank title, and each fifth never closed."""
    k = F.col("c_custkey")
    link = F.when(k % 7 != 0, F.concat(F.lit("https://feed.example/"), k))
    title = F.when(k % 11 != 0, F.col("c_name")).otherwise(" ")
    about, body = F.when(k % 3 != 0, F.concat(F.lit("about "), "c_mktsegment")), F.concat(F.lit("content "), "c_mktsegment")
    creator = F.when(k % 4 != 0, F.concat(F.lit("creator "), "c_nationkey"))
    block = F.concat(F.lit("<item>"), tag("link", link), tag("title", title), tag("description", about), tag("content:encoded", body), tag("dc:creator", creator), tag("author", F.lit("desk")), tag("pubDate", F.lit("Mon, 01 Jan 2024 10:00:00 GMT")), F.when(k % 5 != 0, "</item>").otherwise(""))
    docs = grouped(table(spark, d, "customer").select("c_nationkey", "c_custkey", block.alias("block")), "c_nationkey", "c_custkey", "<rss><channel><title>all</title>", "</channel></rss>")
    return X.rss_items(docs.withColumnRenamed("c_nationkey", "feed"), "body").drop("pos")


@query("""SELECT s_nationkey AS feed, 'https://atom.example/' || s_suppkey AS url, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN '2024-01-02T03:04:05Z' ELSE '2024-02-02T00:00:00Z' END AS published_at,
             CASE WHEN s_suppkey % 3 = 0 THEN 'whole text' ELSE 'short text' END AS summary, CASE WHEN s_suppkey % 4 = 0 THEN 'editors' ELSE 'writer ' || s_suppkey END AS author FROM supplier""")
def atom_entries(spark, d):
    k = F.col("s_suppkey")
    links = F.concat(F.lit('<link rel="self" href="https://atom.example/self"/><link '), F.when(k % 2 == 0, 'rel="alternate" ').otherwise(""), F.lit('href="https://atom.example/'), k, F.lit('"/><link rel="alternate" href="https://atom.example/second"/>'))
    author = F.when(k % 4 != 0, F.concat(F.lit("<author><name>writer "), k, F.lit("</name></author>"))).otherwise("")
    block = F.concat(F.lit("<entry>"), links, tag("title", F.col("s_name")), tag("summary", F.when(k % 3 != 0, "short text")), tag("content", F.lit("whole text")), tag("published", F.when(k % 2 == 0, "2024-01-02T03:04:05Z")), tag("updated", F.lit("2024-02-02T00:00:00Z")), author, F.lit("</entry>"))
    docs = grouped(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", block.alias("block")), "s_nationkey", "s_suppkey", "<feed><title>all</title><author><name>editors</name></author>", "</feed>")
    return X.atom_entries(docs.withColumnRenamed("s_nationkey", "feed"), "body").drop("pos")


@query("""SELECT d.source AS map, 'https://news.example/' || doc_id AS url, 'News ' || doc_id AS title, '2024-01-05' AS published_at, lang FROM documents d WHERE doc_id % 6 <> 0""")
def sitemap_items(spark, d):
    k = F.col("doc_id")
    news = F.concat(F.lit("<news:news><news:publication>"), tag("news:name", F.lit("n")), tag("news:language", F.col("lang")), F.lit("</news:publication>"), tag("news:publication_date", F.lit("2024-01-05")), tag("news:title", F.when(k % 6 != 0, F.concat(F.lit("News "), k))), F.lit("</news:news>"))
    block = F.concat(F.lit("<url>"), tag("loc", F.concat(F.lit("https://news.example/"), k)), news, F.lit("</url>"))
    docs = grouped(table(spark, d, "documents").select("source", "doc_id", block.alias("block")), "source", "doc_id", "<urlset>", "</urlset>")
    return X.sitemap_items(docs.withColumnRenamed("source", "map"), "body").drop("pos")


@query("""SELECT c_custkey AS item_key, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name || ' - Other' ELSE ' - ' || c_mktsegment END AS title, NULL::VARCHAR AS summary FROM customer""")
def publisher_titles(spark, d):
    """Titles with their publisher behind, with another one, and with nothing else."""
    k, p = F.col("c_custkey"), F.col("c_mktsegment")
    title = F.when(k % 3 == 0, F.concat("c_name", F.lit(" - "), p)).when(k % 3 == 1, F.concat("c_name", F.lit(" - Other"))).otherwise(F.concat(F.lit(" - "), p))
    return table(spark, d, "customer").select(k.alias("item_key"), P.strip_publisher(title, p).alias("title"), F.lit(None).cast("string").alias("summary"))


@query("""SELECT 'exploited' AS shape, c_custkey AS id, 'https://www.cisa.gov/known-exploited-vulnerabilities-catalog?field_cve=CVE-2024-' || c_custkey AS url, c_name AS title, '2024-02-03' AS published_at, c_mktsegment AS summary, NULL::VARCHAR AS author FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT 'vulnerability', p_partkey, 'https://nvd.nist.gov/vuln/detail/' || p_brand || p_partkey, p_brand || p_partkey, CASE WHEN p_size % 2 = 0 THEN '2024-01-01T04:00:00.000Z' ELSE '2024-01-01T04:00:00+01:00' END, CASE WHEN p_size % 3 <> 0 THEN p_name END, NULL FROM part WHERE p_partkey % 9 <> 0
    UNION ALL SELECT 'discussion', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.example/' || s_suppkey ELSE 'https://news.ycombinator.com/item?id=' || s_suppkey END, s_name, '2024-01-01T00:00:00Z', NULL, 'poster' FROM supplier
    UNION ALL SELECT 'register', n_nationkey, 'https://register.example/' || n_nationkey, n_name, '2024-03-01', 'abstract', NULL FROM nation WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT 'weather', r_regionkey, 'https://alerts.example/' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'Flood' END, CASE WHEN r_regionkey % 2 = 0 THEN '2024-01-01T00:00:00-04:00' ELSE '2024-01-02T00:00:00-04:00' END, 'told', 'office' FROM region""")
def payload_items(spark, d):
    """The five payload shapes; entries without their mandatory fields, or with numbers in them, are dropped."""

    def of(shape, name, key, body):
        rows = spread(table(spark, d, name)).select(F.lit(shape).alias("shape"), F.col(key).cast("long").alias("id"), F.to_json(body).alias("entry"))
        return P.items(rows, shape, "entry")

    s, c = F.struct, F.col
    key = c("c_custkey")
    cve = F.concat(F.lit("CVE-2024-"), key)
    one = of("exploited", "customer", "c_custkey", s(F.when(key % 14 != 0, F.when(key % 7 != 0, cve).otherwise(" ")).alias("cveID"), c("c_name").alias("vulnerabilityName"), F.lit("2024-02-03").alias("dateAdded"), c("c_mktsegment").alias("shortDescription")))
    told = F.filter(F.array(s(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.when(c("p_size") % 3 != 0, s(F.lit("en").alias("lang"), c("p_name").alias("value"))), s(F.when(c("p_size") % 3 != 0, "en").otherwise("fr").alias("lang"), F.lit("late").alias("value"))), lambda x: x.isNotNull())
    two = of("vulnerability", "part", "p_partkey", s(s(F.when(c("p_partkey") % 9 != 0, F.concat("p_brand", "p_partkey")).alias("id"), F.when(c("p_size") % 2 == 0, "2024-01-01T04:00:00.000").otherwise("2024-01-01T04:00:00+01:00").alias("published"), told.alias("descriptions")).alias("cve")))
    n = c("s_suppkey")
    three = of("discussion", "supplier", "s_suppkey", s(n.cast("string").alias("objectID"), F.when(n % 2 == 0, F.concat(F.lit("https://x.example/"), n)).otherwise("").alias("url"), c("s_name").alias("title"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("poster").alias("author"), n.alias("story_text")))
    title = F.when(c("n_nationkey") % 5 != 0, c("n_name")).otherwise("  ")
    four = of("register", "nation", "n_nationkey", s(F.concat(F.lit("https://register.example/"), "n_nationkey").alias("html_url"), title.alias("title"), F.lit("2024-03-01").alias("publication_date"), F.lit("abstract").alias("abstract")))
    even = c("r_regionkey") % 2 == 0
    props = s(F.when(even, c("r_name")).otherwise("").alias("headline"), F.lit("Flood").alias("event"), F.when(even, "2024-01-01T00:00:00-04:00").alias("sent"), F.lit("2024-01-02T00:00:00-04:00").alias("effective"), F.lit("told").alias("description"), F.lit("office").alias("senderName"))
    five = of("weather", "region", "r_regionkey", s(F.concat(F.lit("https://alerts.example/"), "r_regionkey").alias("id"), props.alias("properties")))
    return one.union(two).union(three).union(four).union(five)


def search_entries(spark, d):
    """Customers as code-host search entries, some broken in one way each."""
    k, c = F.col("c_custkey"), F.col
    entry = F.struct(
        F.when(k % 23 != 0, k).otherwise(0).alias("id"), F.struct(F.when(k % 19 != 0, c("c_mktsegment")).otherwise("a/b").alias("login")).alias("owner"), c("c_name").alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("  tool \n of "), "c_name")).alias("description"), F.lit("").alias("language"), F.struct(F.when(k % 3 == 0, "NOASSERTION").otherwise("MIT").alias("spdx_id")).alias("license"),
        F.when(k % 13 != 0, k * 2).otherwise(-1).alias("stargazers_count"), (k % 40).alias("open_issues_count"), F.when(k % 17 != 0, "2024-01-02T03:04:05Z").otherwise("soon").alias("pushed_at"), (k % 5 == 0).alias("fork"), F.lit(False).alias("archived"),
    )
    return spread(table(spark, d, "customer")).select(k.alias("entry_id"), P.repository(F.try_parse_json(F.to_json(entry))).alias("r"))


@query("""SELECT c_custkey AS repo_id, replace(c_mktsegment, ' ', '') || '/' || c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'tool of ' || c_name END AS description, NULL::VARCHAR AS language,
            CASE WHEN c_custkey % 3 <> 0 THEN 'MIT' END AS licence, c_custkey * 2 AS stars, c_custkey % 40 AS issues, TIMESTAMP '2024-01-02 03:04:05' AS pushed_at, c_custkey % 5 = 0 AS fork, false AS archived
          FROM customer WHERE c_custkey % 23 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 13 <> 0 AND NOT contains(c_name, ' ') AND NOT contains(c_mktsegment, ' ')""")
def typed_repositories(spark, d):
    return search_entries(spark, d).where("r.repo is not null").select("r.repo.*").withColumn("pushed_at", F.col("pushed_at").cast("timestamp_ntz"))


@query("""SELECT CASE WHEN c_custkey % 23 = 0 THEN 'id' WHEN c_custkey % 19 = 0 OR contains(c_mktsegment, ' ') THEN 'owner' WHEN contains(c_name, ' ') THEN 'name' WHEN c_custkey % 17 = 0 THEN 'pushed_at' WHEN c_custkey % 13 = 0 THEN 'stars' ELSE 'accepted' END AS outcome, count(*) AS n FROM customer GROUP BY 1""")
def repository_rejects(spark, d):
    return search_entries(spark, d).groupBy(F.coalesce("r.reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, '{"html_url":"h","n":' || c_custkey || ',"list":[{"name":"' || c_name || '"}]}' AS payload FROM customer""")
def pruned_payloads(spark, d):
    c = F.col
    body = F.to_json(F.struct(F.lit("h").alias("html_url"), F.lit("b").alias("blobs_url"), c("c_custkey").alias("n"), F.array(F.struct(c("c_name").alias("name"), F.lit("x").alias("git_url"))).alias("list")))
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), P.prune_urls(body).alias("payload"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts)
            WHEN 4 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 5 THEN date_trunc('second', ts) + INTERVAL 480 MINUTE WHEN 6 THEN date_trunc('second', ts) END AS published_at FROM events""")
def publication_dates(spark, d):
    """ISO with Z and offsets, date only, RFC 822 with two-digit years and numeric zones, epoch seconds; an offset over 14 hours and a day that no calendar has are null."""
    k, ts = F.col("event_id") % 9, F.col("ts")
    f = lambda p: F.date_format(ts, p)
    forms = (
        F.when(k == 0, F.concat(f("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("999Z"))).when(k == 1, f("yyyy-MM-dd")).when(k == 2, F.concat(f("EEE, d MMM yy HH:mm:ss"), F.lit(" gmt")))
        .when(k == 3, F.unix_seconds(ts.cast("timestamp")).cast("string")).when(k == 4, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))).when(k == 5, F.concat(f("dd MMM yyyy HH:mm:ss"), F.lit(" -0800")))
        .when(k == 6, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))).when(k == 7, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+14:01"))).otherwise(F.concat(f("yyyy"), F.lit("-02-30T00:00:00Z")))
    )
    return table(spark, d, "events").select("event_id", D.publication_date(F.concat(F.lit(" "), forms)).cast("timestamp_ntz").alias("published_at"))


@query("""SELECT c_custkey AS source_id, CASE c_custkey % 5 WHEN 0 THEN c_custkey % 60 * 60000 WHEN 1 THEN c_custkey % 60 * 3600000 WHEN 2 THEN c_custkey % 60 * 86400000 END::BIGINT AS interval_ms FROM customer WHERE c_custkey % 60 <> 0 OR c_custkey % 5 > 2
          UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 60 = 0 AND c_custkey % 5 <= 2""")
def poll_intervals(spark, d):
    k = F.col("c_custkey")
    unit = F.element_at(F.array(*map(F.lit, ["m", "h", "d", "s", ""])), (k % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("source_id"), D.duration_ms(F.concat((k % 60).cast("string"), unit)).alias("interval_ms"))


ELAPSED = lambda a: f"CASE WHEN {a} < 3600000 THEN {a} // 60000 || 'm' WHEN {a} < 172800000 THEN {a} // 3600000 || 'h' ELSE {a} // 86400000 || 'd' END"


@query(f"""WITH a AS (SELECT event_id, event_id % 4 = 0 AS undated, epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(ts) AS ms, epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(TIMESTAMP '2023-12-31 00:00:00') AS seen FROM events)
           SELECT event_id, CASE WHEN undated THEN 'undated, first seen ' || {ELAPSED("seen")} || ' ago' WHEN ms < 0 THEN 'dated after this note' ELSE {ELAPSED("ms")} || ' old' END AS age FROM a""")
def age_clauses(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz").cast("timestamp")
    published = F.when(F.col("event_id") % 4 != 0, F.date_trunc("millisecond", F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", D.age_clause(published, at("2023-12-31 00:00:00"), at("2024-01-20 00:00:00")).alias("age"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN lower(c_mktsegment) || '/' || lower(replace(c_name, '#', '-')) WHEN 1 THEN 'raw-owner/' || lower(replace(c_name, '#', '-')) WHEN 2 THEN 'own' || c_custkey || '/page' WHEN 3 THEN 'own' || c_custkey || '/own' || c_custkey || '.github.io' END AS repo FROM customer""")
def code_host_refs(spark, d):
    k, name = F.col("c_custkey"), F.replace("c_name", F.lit("#"), F.lit("-"))
    url = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    forms = [
        url("https://www.GitHub.com/", F.col("c_mktsegment"), "/", name, ".git"), url("https://raw.githubusercontent.com/Raw-Owner/", name, "/main/README.md?x=1"), url("https://own", k, ".github.io/page/#top"), url("http://own", k, ".github.io"),
        url("https://github.com/topics/", name), url("https://gist.github.com/me/", k), url("https://own", k, ".github.io/a/b"), url("https://github.com/only"),
    ]
    pick = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("id"), T.code_host_ref(pick).alias("repo"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'not http(s)' WHEN page_id % 10 = 1 THEN 'empty' END AS error FROM pages""")
def url_errors(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp://"), F.col("page_id"))).when(F.col("page_id") % 10 == 1, " ").otherwise(F.concat(F.lit("http://a.substack.com/"), F.col("page_id")))
    return table(spark, d, "pages").select("page_id", T.url_error(url).alias("error"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, left(text, 300) AS p FROM documents)
          SELECT doc_id AS item_key, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(CASE WHEN regexp_extract(p, '^(.+) ', 1, 's') <> '' THEN regexp_extract(p, '^(.+) ', 1, 's') ELSE p END, '\\s+$', '') END AS summary FROM t""")
def truncated_summaries(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), T.truncate(F.coalesce("text", F.lit(""))).alias("summary"))


@query("""SELECT c_custkey AS item_key, CASE c_custkey % 4 WHEN 0 THEN 'the summary of ' || c_name WHEN 1 THEN c_name || ' ' || c_name || ' encoded' WHEN 2 THEN c_mktsegment || ' in an object' END AS body FROM customer""")
def payload_bodies(spark, d):
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    say = F.concat
    forms = [
        F.to_json(F.struct(F.lit("short").alias("content"), say(F.lit("the summary of "), name).alias("summary"))), F.to_json(F.struct(say(name, F.lit(" "), name, F.lit(" encoded")).alias("content:encoded"), F.lit("x").alias("description"))),
        F.to_json(F.struct(F.struct(say(seg, F.lit(" in an object")).alias("#text")).alias("description"), F.lit(7).alias("content"))), say(F.lit("{broken "), name),
    ]
    return spread(table(spark, d, "customer")).select(k.alias("item_key"), P.longest_body(F.element_at(F.array(*forms), (k % 4 + 1).cast("int"))).alias("body"))


@query("""SELECT doc_id AS item_key, 'title ' || doc_id || ' ' || coalesce('about ' || lang || ' ', '') || 'a1 b2' AS text, CASE WHEN doc_id % 2 = 0 THEN 'What it says.' ELSE 'arXiv:12 has no such start' END AS abstract FROM documents""")
def scoring_texts(spark, d):
    k = F.col("doc_id")
    abstract = F.when(k % 2 == 0, F.concat(F.lit("arXiv:2401."), k, F.lit("v1 Announce Type: new \n Abstract: What it says."))).otherwise("arXiv:12 has no such start")
    return table(spark, d, "documents").select(k.alias("item_key"), T.scoring_text(F.concat(F.lit("title "), k), F.concat(F.lit("about "), "lang"), F.array(F.lit("a1"), F.lit("b2"))).alias("text"), T.strip_preamble(abstract).alias("abstract"))


VERSION_SQL = """SELECT user_id AS item_key, sum(n)::BIGINT AS versions, sum(b)::BIGINT AS beat_rows, max(ts) AS last_fetched_at FROM (SELECT user_id, 1 AS n, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS b, ts FROM events) GROUP BY 1"""


def incoming(events):
    """Events as fetched items with their beats."""
    beats = F.when(F.col("event_type") == "view", F.array(F.lit("all"), F.lit("view"))).otherwise(F.array(F.col("event_type")))
    return events.select(F.col("user_id").alias("item_key"), F.col("event_id").alias("item_id"), F.col("ts").alias("fetched_at"), F.concat(F.lit("https://items.example/"), "user_id").alias("canonical_url"), beats.alias("beats"))


def appended(spark, items_path: str, beats_path: str):
    items, beats = spark.read.parquet(items_path), spark.read.parquet(beats_path)
    n = beats.groupBy("item_id").agg(F.count("*").alias("b"))
    return items.join(n, "item_id").groupBy("item_key").agg(F.count("*").alias("versions"), F.sum("b").alias("beat_rows"), F.max("fetched_at").alias("last_fetched_at"))


@query(VERSION_SQL)
def append_versions(spark, d):
    """Two appends of versions and bridge rows, read back."""
    base = scratch(spark, "versions")
    rows = incoming(table(spark, d, "events"))
    for part in (0, 1):
        V.append(rows.where(F.col("item_id") % 2 == part), f"{base}/items", {"beats": f"{base}/beats"})
    return appended(spark, f"{base}/items", f"{base}/beats")


@query(VERSION_SQL)
def stream_ingest(spark, d):
    """The same append as a stream: each micro-batch adds its versions and bridge rows once."""
    from tidewatch.plans.operations import stream

    base = scratch(spark, "ingest")
    rows = incoming(stream(spark, d))
    V.append_stream(rows, f"{base}/items", {"beats": f"{base}/beats"}, f"{base}/progress")
    return appended(spark, f"{base}/items", f"{base}/beats")


__all__ = ["NOW"]
