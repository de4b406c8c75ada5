"""Profiles, entities, map roll-ups, supply arcs, dossiers, dictionaries, sweeps and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.functions.names import name_reason
from tidewatch.functions.prose import first_paragraph, first_paragraph_sql
from tidewatch.operators import tables
from tidewatch.operators import versions as V
from tidewatch.plans import NOW, query
from tidewatch.plans.operations import stream
from tidewatch.operators.terms import find_terms
from tidewatch.plans.text import ZONE
from tidewatch.session import local_rows, scratch, spread, table
from tidewatch.streaming import keyed

EDGE = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"


def sql_hit(text: str, term: str, exact: bool) -> str:
    return f"regexp_matches({text}, '{'' if exact else '(?i)'}{EDGE[0]}" + r"[\s-]+".join(term.split()) + f"{EDGE[1]}')"


def hit(text, term: str, exact: bool):
    """Whether a term stands in a text, in its own case only if ``exact``."""
    pattern = T.term_pattern(term)
    return text.rlike(pattern.replace("(?iu)", "(?u)") if exact else pattern)


#: term, exact case, weight.
BOOSTS = [("Licensed under", True, 0.5), ("apache license", False, 0.5), ("mail", False, 1.0)]
SUPPRESSIONS = [("worthless", False, 1.0), ("The", True, 0.2)]


def _sql_list(terms) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_hit('text', t, x)} THEN '{t}' END" for t, x, _ in terms) + "], lambda x: x IS NOT NULL)"


def _sql_sum(terms) -> str:
    return " + ".join(f"CASE WHEN {sql_hit('text', t, x)} THEN {w} ELSE 0 END" for t, x, w in terms)


@query(f"""SELECT doc_id AS item_key, array_to_string({_sql_list(BOOSTS)}, '; ') AS boosts, array_to_string({_sql_list(SUPPRESSIONS)}, '; ') AS suppressions, round(greatest(0.05, least(3.0, 1 + 0.5 * ({_sql_sum(BOOSTS)}) - 0.8 * ({_sql_sum(SUPPRESSIONS)}))), 6)::DOUBLE AS multiplier FROM documents WHERE text IS NOT NULL""")
def profile_matches(spark, d):
    """Terms of a profile that each text holds, by side, and the multiplier that they make."""
    t = F.col("text")
    found = lambda terms: F.array_compact(F.array(*[F.when(hit(t, term, x), F.struct(F.lit(term).alias("term"), F.lit(w).alias("weight"))) for term, x, w in terms]))
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, m: s + m["weight"])
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_key"), found(BOOSTS).alias("b"), found(SUPPRESSIONS).alias("s"))
    return rows.select("item_key", F.array_join("b.term", "; ").alias("boosts"), F.array_join("s.term", "; ").alias("suppressions"), F.round(S.interest_multiplier(total("b"), total("s")), 6).alias("multiplier"))


#: entity, term, exact case, beats that it is limited to.
ALIASES = [("Apache", "apache license", False, None), ("License desk", "Licensed", True, ["src1", "src2", "src3"]), ("Mail", "mail", False, None)]


def entities(texts):
    """(item_key, names) of texts (item_key, title, summary, url, beats): sorted CVE and CWE numbers of title, summary and URL, and aliases of the prose alone, within their beats."""
    prose = F.concat_ws(" ", "title", "summary")
    edge = r"(?iu)(?<![\p{L}\p{N}_])%s(?![\p{L}\p{N}_])"
    ids = [F.transform(F.regexp_extract_all(F.concat_ws(" ", prose, "url"), F.lit(edge % p), F.lit(0)), F.upper) for p in (r"CVE-\d{4}-\d{4,10}", r"CWE-\d{1,5}")]
    numbers = texts.select("item_key", F.explode(F.concat(*ids)).alias("name"))
    found = find_terms(texts, "item_key", ["title", "summary"], [(t, x) for _, t, x, _ in ALIASES])
    rows = local_rows(texts.sparkSession, ALIASES, "name string, term string, exact boolean, scope array<string>")
    named = found.join(F.broadcast(rows), ["term", "exact"])
    open_, scoped = named.where("scope IS NULL"), named.where("scope IS NOT NULL").join(texts.select("item_key", "beats"), "item_key").where(F.arrays_overlap("beats", "scope"))
    every = numbers.union(open_.select("item_key", "name")).union(scoped.select("item_key", "name"))
    return every.groupBy("item_key").agg(F.array_sort(F.collect_set("name")).alias("names"))


ENTITY_SQL = f"""t AS (SELECT doc_id, source, coalesce(text, '') AS title, CASE WHEN doc_id % 3 = 0 THEN 'see cve-2024-' || (1000 + doc_id % 50) || ' and CVE-1-2' END AS summary, CASE WHEN doc_id % 5 = 0 THEN 'https://x.example/cwe-79/mail' ELSE 'https://x.example/' END AS url FROM documents),
    e AS (SELECT doc_id, list_sort(list_distinct(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'CVE-2024-' || (1000 + doc_id % 50) END, CASE WHEN doc_id % 5 = 0 THEN 'CWE-79' END, {", ".join(f"CASE WHEN {sql_hit('title', term, x)}" + (f" AND source IN ({', '.join(repr(b) for b in scope)})" if scope else "") + f" THEN '{name}' END" for name, term, x, scope in ALIASES)}], lambda x: x IS NOT NULL))) AS names FROM t)"""


def entity_texts(spark, d):
    k = F.col("doc_id")
    summary = F.when(k % 3 == 0, F.concat(F.lit("see cve-2024-"), 1000 + k % 50, F.lit(" and CVE-1-2")))
    url = F.when(k % 5 == 0, "https://x.example/cwe-79/mail").otherwise("https://x.example/")
    return table(spark, d, "documents").select(k.alias("item_key"), F.coalesce("text", F.lit("")).alias("title"), summary.alias("summary"), url.alias("url"), F.array("source").alias("beats"))


def extracted(spark, d):
    return entities(entity_texts(spark, d)).withColumnRenamed("item_key", "doc_id")


@query(f"WITH {ENTITY_SQL} SELECT doc_id AS item_key, array_to_string(names, ',') AS entities FROM e WHERE len(names) > 0")
def extracted_entities(spark, d):
    return extracted(spark, d).where(F.size("names") > 0).select(F.col("doc_id").alias("item_key"), F.array_join("names", ",").alias("entities"))


@query(f"""WITH {ENTITY_SQL}, due AS (SELECT * FROM e WHERE doc_id % 2 = 1 ORDER BY doc_id DESC LIMIT 2000), n AS (SELECT doc_id, unnest(names) AS name FROM due)
           SELECT CASE WHEN name LIKE 'CVE-%' THEN 'cve' WHEN name LIKE 'CWE-%' THEN 'cwe' ELSE 'alias' END AS type, count(*) AS found, count(DISTINCT name) AS names, count(DISTINCT doc_id) AS items FROM n GROUP BY 1""")
def entity_sweep_report(spark, d):
    """A sweep of 2,000 items that the ledger lacks at this version, newest first, by type of name."""
    ledger = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_key"))
    due = entity_texts(spark, d).join(ledger, "item_key", "left_anti").orderBy(F.desc("item_key")).limit(2000)
    n = entities(due).select(F.col("item_key").alias("doc_id"), F.explode("names").alias("name"))
    kind = F.when(F.col("name").startswith("CVE-"), "cve").when(F.col("name").startswith("CWE-"), "cwe").otherwise("alias")
    return n.groupBy(kind.alias("type")).agg(F.count("*").alias("found"), F.count_distinct("name").alias("names"), F.count_distinct("doc_id").alias("items"))


@query(f"""WITH {ENTITY_SQL}, due AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS r FROM e)
           SELECT name, count(*) AS items, min(doc_id) AS first_item, count(*) FILTER (r <= 2000) AS in_first_sweep FROM (SELECT doc_id, r, unnest(names) AS name FROM due WHERE r <= 4000) GROUP BY 1""")
def swept_entities(spark, d):
    """Two sweeps of 2,000 items in a row, each with its facts and ledger written: the names that they found, as read back from finished sweeps."""
    base, items = scratch(spark, "entity-sweeps"), entity_texts(spark, d)
    for _ in range(2):
        tables.sweep(base, items, "item_key", "v1", [F.desc("item_key")], 2000, lambda due: entities(due).select("item_key", F.explode("names").alias("name")))
    facts = tables.swept(spark, base, "item_key")
    return facts.groupBy("name").agg(F.count("*").alias("items"), F.min("item_key").alias("first_item"), F.count_if(F.col("sweep") == 1).alias("in_first_sweep"))


@query("""WITH o AS (SELECT l_suppkey AS site_id, max(l_shipdate) FILTER (l_orderkey % 2 = 0) AS a, max(l_shipdate) FILTER (l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY 1)
          SELECT site_id, s_name AS name, greatest(a, b) AS seen_at, CASE WHEN a IS NULL THEN 'inserted' WHEN b IS NULL THEN NULL WHEN b > a THEN 'updated' ELSE 'ignored' END AS second FROM o JOIN supplier ON s_suppkey = site_id""")
def site_upserts(spark, d):
    """The stored site dimension after two batches of observations, as read back, with what the second batch did to each site."""
    path, lines = scratch(spark, "sites"), table(spark, d, "lineitem")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"))
    batch = lambda k: lines.where(F.col("l_orderkey") % 2 == k).groupBy(F.col("l_suppkey").alias("site_id")).agg(F.max("l_shipdate").alias("seen_at")).join(names, "site_id")
    tables.upsert_into(path, batch(0), ["site_id"], "seen_at")
    second = tables.upsert_into(path, batch(1), ["site_id"], "seen_at")
    return spark.read.parquet(path).drop("bucket").join(second.withColumnRenamed("action", "second"), "site_id", "left")


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_suppkey % 10 >= 5 GROUP BY 1)
          SELECT 'place' AS kind, n_name AS name, coalesce(n, 0) AS items, NULL::BOOLEAN AS has_policy_claim FROM nation LEFT JOIN s ON k = n_nationkey
          UNION ALL SELECT 'jurisdiction', r_name, coalesce(sum(n), 0)::BIGINT, r_regionkey % 2 = 0 FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN s ON k = n_nationkey GROUP BY r_name, r_regionkey""")
def map_rollup(spark, d):
    """Items of enough confidence by place and by jurisdiction, none as 0."""
    s = table(spark, d, "supplier").where((F.col("s_suppkey") % 10) / 10 >= 0.5).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    places = table(spark, d, "nation").join(s, "n_nationkey", "left").withColumn("items", F.coalesce("n", F.lit(0)))
    by_region = places.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("items").alias("items"))
    regions = table(spark, d, "region").join(by_region, "r_regionkey", "left")
    one = places.select(F.lit("place").alias("kind"), F.col("n_name").alias("name"), "items", F.lit(None).cast("boolean").alias("has_policy_claim"))
    return one.union(regions.select(F.lit("jurisdiction"), "r_name", F.coalesce("items", F.lit(0)), F.col("r_regionkey") % 2 == 0))


KINDS = ["hq", "fab", "packaging", "datacenter", "colo", "cloud_region", "office"]
STAGES = ["equipment", "fabrication", "packaging", "design", "compute"]
#: Stages by kind of site, and by operator of headquarters (fixed values).
STAGE_OF = {"hq": "equipment", "fab": "fabrication", "packaging": "packaging", "datacenter": "compute", "colo": "compute", "cloud_region": "compute"}
DESIGNERS = ["NVIDIA", "AMD", "Broadcom"]


def stage(kind, operator):
    by_kind = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    return F.when((kind == "hq") & operator.isin(*DESIGNERS), "design").otherwise(F.try_element_at(by_kind, kind))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n, max(o_orderdate) AS latest FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 168 HOUR AND o_orderdate <= TIMESTAMP '1998-08-02' AND o_orderkey % 4 <> 0 GROUP BY 1),
      s AS (SELECT n_nationkey AS site, CASE n_nationkey % 7 WHEN 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 4 END AS stage, coalesce(n, 0) AS n, latest FROM nation LEFT JOIN a ON k = n_nationkey)
      SELECT x.site AS source, y.site AS target, x.n + y.n AS activity, greatest(x.latest, y.latest) AS latest FROM s x JOIN s y ON y.stage = x.stage + 1""")
def supply_chain(spark, d):
    """Arcs between sites at neighbouring stages with their activity of 168 hours and its latest instant."""
    now = F.lit("1998-08-02").cast("timestamp_ntz")
    recent = (F.col("o_orderdate") > now - F.expr("interval 168 hours")) & (F.col("o_orderdate") <= now)
    sure = F.when(F.col("o_orderkey") % 4 != 0, 0.9).otherwise(0.2)
    o = table(spark, d, "orders").where(recent & (sure >= 0.5)).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    a = o.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 7 + 1).cast("int"))
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage(kind, F.when(k % 2 == 0, "NVIDIA").otherwise("none")))
    s = table(spark, d, "nation").join(a, "n_nationkey", "left").select(k.alias("site"), at.alias("stage"), F.coalesce("n", F.lit(0)).alias("n"), "latest")
    x = s.select(F.col("site").alias("source"), (F.col("stage") + 1).alias("stage"), F.col("n").alias("xn"), F.col("latest").alias("xl"))
    y = s.select(F.col("site").alias("target"), "stage", F.col("n").alias("yn"), F.col("latest").alias("yl"))
    return x.join(y, "stage").select("source", "target", (F.col("xn") + F.col("yn")).alias("activity"), F.greatest("xl", "yl").alias("latest"))


@query("""WITH p AS (SELECT p_partkey AS item, CASE WHEN p_size = 7 AND p_partkey % 2 = 0 THEN 'size 7' WHEN p_size = 9 THEN 'Size/9' WHEN p_size = 11 THEN 'Sizé 11' WHEN p_size = 13 THEN '.Size' ELSE 'Size ' || p_size END AS name FROM part),
      c AS (SELECT name, count(*) AS items FROM p GROUP BY 1), x AS (SELECT name, items, count(*) OVER (PARTITION BY lower(name)) > 1 AS clash FROM c WHERE items >= 2)
      SELECT name, items, CASE WHEN clash THEN 'case_collision' WHEN name = 'Size/9' THEN 'separator' WHEN name = '.Size' THEN 'dot_leading' ELSE 'planned' END AS outcome FROM x""")
def dossier_plan(spark, d):
    """Names in composed form with 2 items or more: those that differ in case only, or make no file name, are skipped with the reason."""
    k, n = F.col("p_partkey"), F.col("p_size")
    eleven = F.when(k % 2 == 0, "Sizé 11").otherwise("Sizé 11")
    name = F.when((n == 7) & (k % 2 == 0), "size 7").when(n == 9, "Size/9").when(n == 11, eleven).when(n == 13, ".Size").otherwise(F.concat(F.lit("Size "), n))
    c = table(spark, d, "part").groupBy(T.composed(name).alias("name")).agg(F.count("*").alias("items")).where("items >= 2")
    clash = c.groupBy(F.lower("name").alias("low")).agg((F.count("*") > 1).alias("clash"))
    outcome = F.when(F.col("clash"), "case_collision").otherwise(F.coalesce(name_reason(F.col("name")), F.lit("planned")))
    return c.join(clash, F.lower("name") == F.col("low")).select("name", "items", outcome.alias("outcome"))


DICTIONARY_SQL = """t AS (SELECT 'boost' AS side, p_brand || ' ' || p_size AS term, p_partkey AS entity, p_partkey % 3 AS link FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'suppress', CASE WHEN p_partkey % 5 = 0 THEN upper(p_brand) ELSE p_brand END || ' ' || p_size, p_partkey, p_partkey % 4 FROM part WHERE p_partkey % 7 = 0)"""


@query(f"""WITH {DICTIONARY_SQL} SELECT 'duplicate' AS issue, term AS subject FROM t GROUP BY side, term HAVING count(*) > 1 UNION ALL SELECT 'on both sides', term FROM t GROUP BY term HAVING count(DISTINCT side) > 1
      UNION ALL SELECT 'claimed twice', term FROM t GROUP BY term HAVING count(DISTINCT entity) > 1 UNION ALL SELECT 'case only', lower(term) FROM t GROUP BY lower(term) HAVING count(DISTINCT term) > 1 UNION ALL SELECT DISTINCT 'dangling link', link::VARCHAR FROM t WHERE link NOT IN (0, 1, 2)""")
def dictionary_checks(spark, d):
    """Duplicates, terms on both sides, terms that two entities claim, terms that differ in case only, links to nothing."""
    p = table(spark, d, "part")
    k, term = F.col("p_partkey"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    loud = F.concat_ws(" ", F.when(k % 5 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.col("p_size").cast("string"))
    t = p.where(k % 2 == 0).select(F.lit("boost").alias("side"), term.alias("term"), k.alias("entity"), (k % 3).alias("link")).union(p.where(k % 7 == 0).select(F.lit("suppress"), loud, k, k % 4))
    issue = lambda rows, what, c: rows.select(F.lit(what).alias("issue"), F.col(c).cast("string").alias("subject"))
    by_term = t.groupBy("term").agg(F.count_distinct("side").alias("sides"), F.count_distinct("entity").alias("entities"))
    cases = t.groupBy(F.lower("term").alias("low")).agg(F.count_distinct("term").alias("n")).where("n > 1")
    known = spark.createDataFrame([(0,), (1,), (2,)], "link long")
    parts = [issue(t.groupBy("side", "term").count().where("count > 1"), "duplicate", "term"), issue(by_term.where("sides > 1"), "on both sides", "term"), issue(by_term.where("entities > 1"), "claimed twice", "term"), issue(cases, "case only", "low"), issue(t.select("link").distinct().join(known, "link", "left_anti"), "dangling link", "link")]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@query("""WITH o AS (SELECT s_suppkey AS id, s_name AS name, 1 AS version FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' new' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 0), m AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN n.name <> o.name THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.id = n.id),
      l AS (SELECT l_suppkey AS id, count(*) AS items, round(max(l_discount), 6) AS best FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1) SELECT m.id AS site_id, name, action, coalesce(items, 0) AS items, best AS best_confidence FROM m LEFT JOIN l ON l.id = m.id""")
def seeded_sites(spark, d):
    """Sites upserted by id from a file, with their items of enough confidence."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"))
    old, new = s.where("site_id % 3 <> 0").withColumnRenamed("name", "old"), s.where("site_id % 5 <> 0").select("site_id", F.when(F.col("site_id") % 2 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("new"))
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("new") != F.col("old"), "updated").otherwise("unchanged")
    m = old.join(new, "site_id", "full_outer").select("site_id", F.coalesce("new", "old").alias("name"), action.alias("action"))
    items = table(spark, d, "lineitem").where("l_discount >= 0.05").groupBy(F.col("l_suppkey").alias("site_id")).agg(F.count("*").alias("items"), F.round(F.max("l_discount"), 6).alias("best_confidence"))
    return m.join(items, "site_id", "left").select("site_id", "name", "action", F.coalesce("items", F.lit(0)).alias("items"), "best_confidence").orderBy("name")


@query(f"""WITH v AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts FROM events GROUP BY 1), p AS (SELECT user_id, id, ts, (props::JSON ->> '$.k')::BIGINT AS k FROM v JOIN events USING (user_id, ts) WHERE event_id = id)
      SELECT user_id AS repo_id, 'own/r' || user_id AS full_name, k AS stars, (ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')::DATE AS snapshot_day, ts AS observed_at FROM p WHERE id % 5 <> 0 AND id % 7 <> 0""")
def snapshot_sweep(spark, d):
    """Latest payload of each repository as a daily reading; payloads with a star count that is no count, or no name, are refused."""
    v = V.current(table(spark, d, "events").select(F.col("user_id").alias("item_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("ingest_seq"), "props"), ["item_key"])
    k, i = F.get_json_object("props", "$.k"), F.col("ingest_seq")
    stars = F.when(i % 5 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    body = F.concat(F.lit('{"id":'), "item_key", F.lit(',"stargazers_count":'), stars, F.when(i % 7 != 0, F.concat(F.lit(',"full_name":"own/r'), "item_key", F.lit('"'))).otherwise(""), F.lit("}"))
    p = F.try_parse_json(body)
    count = F.when(F.schema_of_variant(F.try_variant_get(p, "$.stargazers_count", "variant")) == "BIGINT", F.try_variant_get(p, "$.stargazers_count", "bigint"))
    name = F.try_variant_get(p, "$.full_name", "string")
    rows = v.select(F.try_variant_get(p, "$.id", "bigint").alias("repo_id"), name.alias("full_name"), count.alias("stars"), F.to_date(F.from_utc_timestamp(F.col("fetched_at").cast("timestamp"), ZONE)).alias("snapshot_day"), F.col("fetched_at").alias("observed_at"))
    return rows.where(F.coalesce((F.col("stars") >= 0) & F.col("full_name").rlike("^[^/]+/[^/]+$"), F.lit(False)))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS item_key, o_orderpriority AS beat FROM orders), s AS (SELECT o_custkey AS item_key, o_orderpriority AS beat, arg_max('v' || o_orderkey % 3, (o_orderdate, o_orderkey)) AS version FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2)
      SELECT b.item_key, string_agg(b.beat, ',' ORDER BY b.beat) AS beats, count(*) FILTER (version IS NULL) AS missing, count(*) FILTER (version <> 'v1') AS outdated FROM b LEFT JOIN s ON s.item_key = b.item_key AND s.beat = b.beat GROUP BY 1 HAVING count(*) FILTER (version IS NULL OR version <> 'v1') > 0""")
def scoring_worklist(spark, d):
    """Items to score: some beat has no latest score, or one of another version of the scorer."""
    return due(spark, d, "v1")


def due(spark, d, version: str, force: bool = False):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item_key"), F.col("o_orderpriority").alias("beat"), "o_orderdate", "o_orderkey")
    scores = o.where("o_orderkey % 4 <> 0").withColumn("version", F.concat(F.lit("v"), F.col("o_orderkey") % 3))
    latest = V.newest(scores, ["item_key", "beat"], "o_orderdate", "o_orderkey").select("item_key", "beat", "version")
    both = o.select("item_key", "beat").distinct().join(latest, ["item_key", "beat"], "left")
    out = both.groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_list("beat")), ",").alias("beats"), F.count_if(F.col("version").isNull()).alias("missing"), F.count_if(F.col("version") != version).alias("outdated"))
    return out if force else out.where("missing + outdated > 0")


@query("""WITH c AS (SELECT o_orderpriority AS beat, count(DISTINCT o_custkey) AS candidates FROM orders GROUP BY 1), s AS (SELECT o_orderpriority AS beat, count(DISTINCT o_custkey) AS scored FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1) SELECT c.beat, candidates, coalesce(scored, 0) AS scored FROM c LEFT JOIN s ON s.beat = c.beat""")
def beat_coverage(spark, d):
    """Candidates of each beat and how many of them have a score."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("beat")).agg(F.count_distinct("o_custkey").alias("candidates"), F.count_distinct(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))).alias("scored"))


@query("""WITH s AS (SELECT c_custkey AS item_key, c_mktsegment AS seg, c_custkey % 4 = 0 AS repo, c_acctbal / 1000 AS rate, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.0 END AS hn, greatest(0, least(1, (c_custkey % 20) * 0.1 / 1.9)) AS w, greatest(0, least(1, log2(greatest(c_custkey % 12, 1)) / 3)) AS c FROM customer),
      b AS (SELECT *, unnest(CASE WHEN repo THEN ['repos', seg] ELSE [seg] END) AS beat, CASE WHEN repo THEN sign(rate) * log2(1 + abs(rate)) * 0.75 ELSE 0 END AS v FROM s)
      SELECT item_key, beat, round(10 * (0.6 * c + 0.4 * w + CASE WHEN repo THEN 0.2 * v - 0.1 * hn ELSE 0 END), 6)::DOUBLE AS signal_score, round(10 * (0.3 * c + 0.7 * w + CASE WHEN repo THEN 0.1 * v - 0.2 * hn ELSE 0 END), 6)::DOUBLE AS read_score FROM b""")
def scores_by_beat(spark, d):
    """Both profiles of each item and beat; repositories also gain by their growth and lose by discussion that they have had."""
    k = F.col("c_custkey")
    repo, rate = k % 4 == 0, F.col("c_acctbal") / 1000
    w, c = S.source_weight(0.1 + (k % 20) * 0.1), S.cluster_size(k % 12)
    v = F.when(repo, F.signum(rate) * F.log2(1 + F.abs(rate)) * 0.75).otherwise(0.0)
    hn = F.when(repo, F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.6).otherwise(0.0)).otherwise(0.0)
    one = lambda a, b, x, y: F.round(10 * (a * F.col("c") + b * F.col("w") + x * F.col("v") - y * F.col("hn")), 6)
    beats = F.when(repo, F.array(F.lit("repos"), F.col("c_mktsegment"))).otherwise(F.array("c_mktsegment"))
    rows = table(spark, d, "customer").select(k.alias("item_key"), F.explode(beats).alias("beat"), w.alias("w"), c.alias("c"), v.alias("v"), hn.alias("hn"))
    return rows.select("item_key", "beat", one(0.6, 0.4, 0.2, 0.1).alias("signal_score"), one(0.3, 0.7, 0.1, 0.2).alias("read_score"))


@query(f"SELECT date_trunc('hour', ts) AS hour, count(*) AS n, max(ts) AS latest FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def stream_hours(spark, d):
    """Activity of the trailing 168 hours by hour, as a stream: one row of state an hour, which goes when the watermark has left it behind."""
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = stream(spark, d).where((F.col("ts") > now - F.expr("interval 168 hours")) & (F.col("ts") <= now))
    return keyed.last_rows(keyed.hourly(rows, "168 hours"), "hour")[0]


@query(f"SELECT doc_id AS item_key, paragraph FROM (SELECT doc_id, {first_paragraph_sql('text')} AS paragraph FROM documents WHERE text IS NOT NULL) WHERE paragraph IS NOT NULL")
def prose_paragraphs(spark, d):
    """The first paragraph of prose of every document that has one."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc_id").alias("item_key"), F.explode(F.array_compact(F.array(first_paragraph(F.col("text"))))).alias("paragraph"))


@query(f"SELECT page_id AS item_key, paragraph FROM (SELECT page_id, {first_paragraph_sql('html')} AS paragraph FROM pages WHERE html IS NOT NULL) WHERE paragraph IS NOT NULL")
def page_paragraphs(spark, d):
    """The first paragraph of prose of every web page that has one: navigation, headings and scripts are none."""
    rows = spread(table(spark, d, "pages").select("page_id", "html"))
    return rows.select(F.col("page_id").alias("item_key"), F.explode(F.array_compact(F.array(first_paragraph(F.col("html"))))).alias("paragraph"))


SAVED_SQL = """SELECT c_custkey AS item_key, '# ' || c_name AS line, 1 AS n FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'Source: ' || c_mktsegment, 2 FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'Orders: ' || string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey), 3 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 = 0 GROUP BY 1"""


@query(SAVED_SQL)
def saved_note_lines(spark, d):
    """Lines of the note of each saved item, in order: title, source, what belongs to it."""
    c = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("item_key"), "c_name", "c_mktsegment")
    keys = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ", ").alias("keys"))
    lines = F.array_compact(F.array(F.concat(F.lit("# "), "c_name"), F.concat(F.lit("Source: "), "c_mktsegment"), F.concat(F.lit("Orders: "), "keys")))
    return c.join(keys, "item_key", "left").select("item_key", F.posexplode(lines).alias("p", "line")).select("item_key", "line", (F.col("p") + 1).alias("n"))


@query("""WITH v AS (SELECT user_id AS item_key, event_id, ts, event_type || ' ' || (event_id % 9) AS title FROM events), c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY ts DESC, event_id DESC) = 1)
      SELECT item_key, unnest(list_distinct(string_split(title, ' '))) AS term FROM c""")
def index_upkeep(spark, d):
    """The search index after revisions: each batch of versions replaces what the index had of its items, so only current versions are in it."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("item_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("ingest_seq"), F.concat_ws(" ", "event_type", (F.col("event_id") % 9).cast("string")).alias("title"))
    held = None
    for part in (0, 1, 2):
        held = replaced(held, rows.where(F.col("ingest_seq") % 3 == part))
    return held.select("item_key", F.explode("terms").alias("term"))


def replaced(index, batch):
    """Index rows (item_key, fetched_at, ingest_seq, terms) after a batch of versions: newer versions replace, older ones are ignored."""
    new = V.current(batch, ["item_key"]).select("item_key", "fetched_at", "ingest_seq", F.array_distinct(F.split("title", " ")).alias("terms"))
    return new if index is None else V.newest(index.unionByName(new), ["item_key"], "fetched_at", "ingest_seq")


LOOKUP_SQL = """v AS (SELECT user_id AS item_key, min(ts) AS first_seen, arg_max(event_type, (ts, event_id)) AS source, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS beats FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1),
    s AS (SELECT user_id AS item_key, arg_max(value, (ts, event_id)) AS score, max(ts) AS scored_at FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND event_id % 3 <> 0 GROUP BY 1),
    k AS (SELECT v.*, score, score * pow(0.5, (epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(scored_at)) / 3600 / 48) AS decayed FROM v LEFT JOIN s ON s.item_key = v.item_key WHERE v.item_key % 2 = 0 AND source IN ('view', 'signup') AND first_seen >= TIMESTAMP '2024-01-01 06:00:00')"""


@query(f"""WITH {LOOKUP_SQL}, c AS (SELECT (SELECT count(*) FROM v WHERE item_key % 2 = 0) AS candidates, count(*) FILTER (decayed >= 5) AS matched, count(*) FILTER (score IS NULL) AS unscored_excluded FROM k)
      SELECT row_number() OVER (ORDER BY decayed DESC, item_key)::INTEGER AS place, item_key, source, beats, round(score, 6) AS score, round(decayed, 6) AS decayed, candidates, matched, unscored_excluded FROM k, c WHERE decayed >= 5 ORDER BY place LIMIT 25""")
def entity_lookup(spark, d):
    """Items of an entity as of an instant: versions, beats and scores of then, kinds news and advisory by default, first-seen bound, score floor, with what each of these left."""
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").where(F.col("ts") <= at)
    order = F.struct("ts", "event_id")
    v = e.groupBy(F.col("user_id").alias("item_key")).agg(F.min("ts").alias("first_seen"), F.max_by("event_type", order).alias("source"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("beats"))
    s = e.where("event_id % 3 <> 0").groupBy(F.col("user_id").alias("item_key")).agg(F.max_by("value", order).alias("score"), F.max("ts").alias("scored_at"))
    mine = v.where("item_key % 2 = 0").join(s, "item_key", "left")
    kinds = F.create_map(F.lit("view"), F.lit("news"), F.lit("signup"), F.lit("advisory"), F.lit("purchase"), F.lit("blog"))
    kept = F.coalesce(kinds[F.col("source")].isin("news", "advisory"), F.lit(False)) & (F.col("first_seen") >= F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))
    hours = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("scored_at").cast("timestamp"))) / 3600e6
    rows = mine.withColumn("decayed", F.col("score") * F.pow(F.lit(0.5), hours / 48)).withColumn("kept", kept)
    good = F.col("kept") & (F.col("decayed") >= 5)
    counts = rows.agg(F.count("*").alias("candidates"), F.count_if(good).alias("matched"), F.count_if(F.col("kept") & F.col("score").isNull()).alias("unscored_excluded")).withColumn("one", F.lit(1))
    by = [F.desc("decayed"), F.col("item_key")]
    page = rows.where(good).orderBy(*by).limit(25)  # a bounded page, then numbered
    page = page.withColumn("place", F.row_number().over(Window.orderBy(*by))).withColumn("one", F.lit(1))
    return page.join(F.broadcast(counts), "one").select("place", "item_key", "source", "beats", F.round("score", 6).alias("score"), F.round("decayed", 6).alias("decayed"), "candidates", "matched", "unscored_excluded")
