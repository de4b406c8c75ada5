"""Envelopes, dictionaries, extraction, search and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.scoring import log_odds_z
from tidewatch.operators.passes import as_row, counted_write
from tidewatch.operators.search import SearchIndex
from tidewatch.operators.versions import newest
from tidewatch.plans import query
from tidewatch.sources import feeds
from tidewatch.session import scratch, spread, stored, table


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' AND user_id % 10 <> 0")
def json_entries(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    body = e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "value")).alias("hits"))).alias("body"))
    broken = body.withColumn("body", F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("{"), "body")).otherwise(F.col("body")))
    return feeds.json_entries(broken, "body", "hits", "struct<event_id: bigint, value: double>")


def xml_rows(spark, d):
    """Small XML items built from pages, every tenth without a link."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    link = F.when(F.col("page_id") % 10 != 0, F.concat(F.lit("<link>"), safe(F.col("url")), F.lit("</link>"))).otherwise("")
    docs = table(spark, d, "pages").select("page_id", F.concat(F.lit("<item>"), link, F.lit("<title>page "), "page_id", F.lit("</title></item>")).alias("body"))
    return feeds.xml_entries(docs, "body", "link string, title string")


@query("SELECT page_id, trim(url) AS link, 'page ' || page_id AS title FROM pages WHERE page_id % 10 <> 0")
def xml_entries(spark, d):
    return xml_rows(spark, d).where(feeds.accepted(F.col("link"), F.col("title")))


@query("SELECT CASE WHEN page_id % 10 = 0 THEN 'missing field' ELSE 'accepted' END AS outcome, count(*) AS n FROM pages GROUP BY 1")
def rejected_entries(spark, d):
    return xml_rows(spark, d).groupBy(F.when(feeds.accepted(F.col("link"), F.col("title")), "accepted").otherwise("missing field").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS entries, count(*) FILTER (page_id % 10 <> 0) AS accepted, count(*) FILTER (page_id % 10 = 0) AS rejected, count(*) FILTER (page_id % 10 <> 0) AS read_back FROM pages")
def counted_entries(spark, d):
    """Entries that are parsed, written and counted in one scan; malformed ones are left out and counted."""
    rows, path = xml_rows(spark, d), scratch(spark, "entries")
    good = feeds.accepted(F.col("link"), F.col("title"))
    counts = counted_write(rows, path, good, {"entries": F.count("*"), "accepted": F.count_if(good), "rejected": F.count_if(~F.coalesce(good, F.lit(False)))})
    return as_row(rows, counts | {"read_back": spark.read.schema(rows.schema).parquet(path).count()})


@query("SELECT source, count(*) FILTER (lang IS NULL OR lang IN ('en', 'de')) AS kept, count(*) FILTER (lang NOT IN ('en', 'de')) AS filtered FROM documents GROUP BY source")
def language_filter(spark, d):
    docs = table(spark, d, "documents")
    kept = feeds.languages(docs, "lang", ["en", "de"]).groupBy("source").agg(F.count("*").alias("kept"))
    return docs.groupBy("source").agg(F.count("*").alias("n")).join(kept, "source", "left").select("source", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("filtered"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 15")
def cap_recent(spark, d):
    return feeds.cap_recent(table(spark, d, "documents").select("source", "doc_id"), "source", F.col("doc_id"), 15)


@query("""WITH u AS (SELECT c_custkey AS id, 1 AS request, c_name AS name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
          SELECT id, request, name FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY request) = 1""")
def dedup_union(spark, d):
    c = table(spark, d, "customer")
    one = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("request"), F.col("c_name").alias("name"))
    two = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(2).alias("request"), F.col("c_mktsegment").alias("name"))
    return feeds.first_of(one.unionByName(two), "id", "request")


MENTION_SQL = """SELECT doc_id AS item_key, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[a-z0-9.]+'))), ',') AS entities FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[a-z0-9.]+')"""


@query(MENTION_SQL)
def entity_mentions(spark, d):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[a-z0-9.]+"), F.lit(0))))
    return table(spark, d, "documents").where(F.col("text").rlike("[A-Za-z0-9._]+@[a-z0-9.]+")).select(F.col("doc_id").alias("item_key"), F.array_join(found, ",").alias("entities"))


@query("SELECT doc_id AS item_key, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[a-z0-9.]+')))::INTEGER AS entity_count FROM documents WHERE doc_id % 2 = 1 ORDER BY doc_id DESC LIMIT 2000")
def extraction_sweep(spark, d):
    docs = table(spark, d, "documents")
    ledger = docs.where("doc_id % 2 = 0").select("doc_id")
    due = docs.join(ledger, "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(2000)
    return due.select(F.col("doc_id").alias("item_key"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[a-z0-9.]+"), F.lit(0)))).alias("entity_count"))


@query("SELECT source, count(*) AS total, count(*) FILTER (doc_id % 2 = 0) AS done, count(*) FILTER (doc_id % 2 <> 0) AS remaining FROM documents GROUP BY source")
def extraction_coverage(spark, d):
    docs = table(spark, d, "documents")
    ledger = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("done"))
    both = docs.select("doc_id", "source").join(ledger, "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("total"), F.count("done").alias("done"), F.count_if(F.col("done").isNull()).alias("remaining"))


INDEX_SQL = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
    i AS (SELECT term, doc_id AS item_key, count(*) AS tf FROM w GROUP BY 1, 2)"""


def index(spark, d):
    """Inverted index of current texts: (term, item_key, tf)."""
    terms = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_key"), terms.alias("term")).groupBy("term", "item_key").agg(F.count("*").alias("tf"))


@query(f"WITH {INDEX_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, max(tf) AS most FROM i GROUP BY term")
def search_index(spark, d):
    return index(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


@query(f"""WITH {INDEX_SQL}, l AS (SELECT item_key, sum(tf) AS n FROM i GROUP BY 1), g AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
      q AS (SELECT i.*, count(*) OVER (PARTITION BY term) AS df FROM i WHERE term IN ('the', 'and', 'for'))
      SELECT q.item_key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS rank FROM q JOIN l ON q.item_key = l.item_key CROSS JOIN g
      GROUP BY 1 HAVING count(*) = 3 ORDER BY rank DESC, item_key LIMIT 100""")
def search_hits(spark, d):
    """A query of three words over the stored index; no text is read."""
    return document_index(spark, d).search("the and for", 100).select("item_key", "rank")


_indexes: dict[tuple[str, str], SearchIndex] = {}


def document_index(spark, d) -> SearchIndex:
    """The stored index of the documents, titles (first lines) apart from bodies: made by a session's first search, then read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        body = F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1)
        rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_key"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit(1).cast("long").alias("ingest_seq"), F.substring_index("text", "\n", 1).alias("title"), body.alias("body"))
        made = SearchIndex(spark, scratch(spark, "search"), ["title", "body"])
        made.upsert(spread(rows))
        _indexes[key] = made
    return _indexes[key]


@query(r"""WITH f AS (SELECT doc_id, 0 AS field, 3.0 AS weight, split_part(text, chr(10), 1) AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1, 1.0, regexp_extract(text, '^[^\n]*\n(.*)$', 1, 's') FROM documents WHERE text IS NOT NULL),
      k AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM f),
      w AS (SELECT doc_id, field, weight, t, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS at_ FROM k),
      l AS (SELECT doc_id, sum(len(ws)) AS n FROM k GROUP BY 1 HAVING sum(len(ws)) > 0), g AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
      h AS (SELECT 0 AS phrase, a.doc_id, a.field, a.weight, a.t, a.at_ FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.field = b.field AND b.at_ = a.at_ + 1 WHERE a.word = 'of' AND b.word = 'the' UNION ALL SELECT 1, doc_id, field, weight, t, at_ FROM w WHERE word = 'and'),
      e AS (SELECT phrase, doc_id, sum(weight) AS tf, min((field, at_)) AS place, arg_min(t, (field, at_)) AS t FROM h GROUP BY 1, 2),
      q AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM e),
      r AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6)::DOUBLE AS rank, arg_min(place[2], phrase) AS first_, arg_min(t, phrase) AS t
            FROM q JOIN l USING (doc_id), g GROUP BY 1 HAVING count(*) = 2 ORDER BY rank DESC, doc_id LIMIT 50),
      s AS (SELECT *, regexp_extract_all(t, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS pieces, greatest(first_ - 6, 0) AS begin_ FROM r)
      SELECT doc_id AS item_key, rank, trim(regexp_replace(array_to_string(list_transform(pieces[begin_ + 1:begin_ + 12], lambda p, i: CASE WHEN i - 1 + begin_ >= first_ AND i - 1 + begin_ < first_ + 2 THEN regexp_replace(p, '^([\p{L}\p{N}]+)', '[\1]') ELSE p END), ''), '[ \t\n\v\f\r]+', ' ', 'g')) AS snippet FROM s""")
def ranked_search(spark, d):
    """A phrase and a word over the stored index, titles counting three times, each hit with a snippet."""
    return document_index(spark, d).search("of-the AND", 50, [3.0, 1.0])


@query(r"""WITH t AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g'))), 'the') AS at_ FROM t)
          SELECT doc_id AS item_key, array_to_string(w[greatest(1, at_ - 5):greatest(1, at_ - 5) + 11], ' ') AS snippet FROM p WHERE at_ > 0""")
def search_snippets(spark, d):
    """Twelve words about the first hit of a term in each text that has it."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    plain = F.transform("w", lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")))
    hit = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_key"), w.alias("w")).withColumn("at", F.array_position(plain, "the")).where("at > 0")
    first = F.greatest(F.lit(1), F.col("at") - 5).cast("int")
    return hit.select("item_key", F.array_join(F.slice("w", first, F.lit(12)), " ").alias("snippet"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]{4}$'))) AS term FROM documents),
      k AS (SELECT doc_id, toxic FROM labels), n AS (SELECT count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b FROM k),
      c AS (SELECT term, count(*) FILTER (toxic = 1) AS x, count(*) FILTER (toxic = 0) AS y FROM w JOIN k USING (doc_id) GROUP BY 1),
      z AS (SELECT term, x, y, round((ln((x + 0.5) / (a - x + 0.5)) - ln((y + 0.5) / (b - y + 0.5))) / sqrt(1 / (x + 0.5) + 1 / (a - x + 0.5) + 1 / (y + 0.5) + 1 / (b - y + 0.5)), 6) AS z FROM c, n WHERE x >= 3)
      SELECT * FROM z WHERE z >= 1.96 ORDER BY z DESC, term LIMIT 20""")
def mined_terms(spark, d):
    k = table(spark, d, "labels").select("doc_id", "toxic")
    size = lambda kind: k.agg(F.count_if(F.col("toxic") == kind)).scalar()
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]{4}$")))
    w = table(spark, d, "documents").join(k, "doc_id").select("toxic", F.explode(terms).alias("term"))
    c = w.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("x"), F.count_if(F.col("toxic") == 0).alias("y")).where("x >= 3")
    c = c.withColumns({"a": size(1), "b": size(0)})
    return c.select("term", "x", "y", F.round(log_odds_z(F.col("x"), F.col("a"), F.col("y"), F.col("b")), 6).alias("z")).where("z >= 1.96").orderBy(F.desc("z"), "term").limit(20)


TOKENS = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' '"


@query(f"""WITH b AS (SELECT item_id, {TOKENS.format("text")} AS run FROM benchmark), d AS (SELECT doc_id, {TOKENS.format("text")} AS words FROM documents WHERE text IS NOT NULL)
           SELECT item_id, count(doc_id) AS documents, min(doc_id) AS first_document FROM b LEFT JOIN d ON length(run) > 2 AND contains(words, run) GROUP BY 1""")
def mentions(spark, d):
    """Documents that hold a whole passage as a run of tokens, wherever it stands: an equi-join on the passage's rarest word, then the test of the run."""
    named = table(spark, d, "benchmark").select("item_id", T.slug_tokens(F.col("text")).alias("run"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.slug_tokens(F.col("text")).alias("words"))
    wanted = named.select("item_id", "run", F.explode(F.array_distinct("run")).alias("w"))
    words = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("w")).join(wanted.select("w").distinct(), "w")
    # written once: it gives both the frequencies and the candidates
    words = stored(words, "passage-words")
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "w", "left").groupBy("item_id").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    pairs = words.join(rarest, "w").select("doc_id", "item_id").join(named, "item_id").join(docs, "doc_id")
    hits = pairs.where(T.has_token_run(F.col("words"), F.col("run"))).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))
    return named.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_document")


@query("""WITH l AS (SELECT * FROM (VALUES ('a1', 'Acme', 0), ('a2', 'acme', 0), ('b1', 'Beta', 0), ('b2', 'Beta', 1)) AS t(id, name, stage)),
      p AS (SELECT id, name FROM l UNION ALL SELECT 'brand-' || p_brand, p_brand FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'type-' || p_partkey % 7, 'TYPE' || p_partkey % 7 FROM part GROUP BY ALL)
      SELECT lower(name) AS claimed, count(*) AS n, CASE WHEN count(DISTINCT name) > 1 THEN 'case only' ELSE 'duplicate' END AS issue FROM p GROUP BY 1 HAVING count(*) > 1""")
def dictionary_issues(spark, d):
    planted = spark.createDataFrame([("a1", "Acme"), ("a2", "acme"), ("b1", "Beta"), ("b2", "Beta")], "id string, name string")
    part = table(spark, d, "part")
    brands = part.select("p_brand").distinct().select(F.concat(F.lit("brand-"), "p_brand").alias("id"), F.col("p_brand").alias("name"))
    kinds = part.select((F.col("p_partkey") % 7).alias("k")).distinct().select(F.concat(F.lit("type-"), "k").alias("id"), F.concat(F.lit("TYPE"), "k").alias("name"))
    return planted.union(brands).union(kinds).groupBy(F.lower("name").alias("claimed")).agg(F.count("*").alias("n"), F.when(F.count_distinct("name") > 1, "case only").otherwise("duplicate").alias("issue")).where("n > 1")


@query("""WITH e AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
      x AS (SELECT *, CASE WHEN toxic = 1 THEN 'dismissed' WHEN quality = 0 THEN 'read' WHEN quality IS NULL THEN 'outside window' ELSE 'kept' END AS reason FROM e)
      SELECT reason, count(*) AS n FROM x GROUP BY 1""")
def weekly_exclusions(spark, d):
    return reading(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def reading(spark, d):
    """Documents with the first reason that keeps each from the reading list."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    reason = F.when(F.col("toxic") == 1, "dismissed").when(F.col("quality") == 0, "read").when(F.col("quality").isNull(), "outside window").otherwise("kept")
    return docs.select(F.col("doc_id").alias("item_key"), n.alias("words"), reason.alias("reason"))


@query("""WITH e AS (SELECT doc_id AS item_key, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INTEGER AS words FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 1),
      r AS (SELECT *, CASE WHEN words >= 400 THEN 'body' ELSE 'headline' END AS list FROM e)
      SELECT list, item_key, words FROM r QUALIFY row_number() OVER (PARTITION BY list ORDER BY words DESC, item_key) <= CASE list WHEN 'body' THEN 12 ELSE 10 END""")
def weekly_reading(spark, d):
    from pyspark.sql import Window

    r = reading(spark, d).where("reason = 'kept'").withColumn("list", F.when(F.col("words") >= 400, "body").otherwise("headline"))
    w = Window.partitionBy("list").orderBy(F.desc("words"), "item_key")
    return r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.when(F.col("list") == "body", 12).otherwise(10)).select("list", "item_key", "words")


@query("""SELECT conv_id, turn, '[' || replace(replace(left(text, 60), '[', '\\['), ']', '\\]') || '](' || conv_id || '-' || turn || ')' AS line FROM conversations WHERE role = 'user'""")
def digest_lines(spark, d):
    head = F.substring("text", 1, 60)
    label = F.replace(F.replace(head, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("["), label, F.lit("]("), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(")")).alias("line"))


@query("""SELECT lang, arg_max(doc_id, (n_chars, doc_id)) AS longest, max(n_chars) AS n_chars FROM documents GROUP BY lang""")
def longest_by_language(spark, d):
    return newest(table(spark, d, "documents").select("lang", F.col("doc_id").alias("longest"), "n_chars"), ["lang"], "n_chars", "longest")
