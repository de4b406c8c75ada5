"""Co-occurrence graphs, dossiers, places and supply arcs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.related import related
from tidewatch.plans import query
from tidewatch.session import table

BASKET_SQL = "p AS (SELECT DISTINCT l_orderkey AS item_key, p_brand AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)"
FLOOR, NEIGHBOURS = 2, 15


def mentions(spark, d):
    """(item_key, entity), distinct."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_key"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("item_key", "entity").distinct()


@query(f"WITH {BASKET_SQL} SELECT entity, count(*) AS items FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY items DESC, entity")
def entity_list(spark, d):
    return mentions(spark, d).groupBy("entity").agg(F.count("*").alias("items")).where("items >= 2").orderBy(F.desc("items"), "entity")


NODE_SQL = f"""{BASKET_SQL}, c AS (SELECT entity, count(*) AS items FROM p GROUP BY 1),
    f AS (SELECT item_key FROM p WHERE entity = (SELECT min(entity) FROM p)), s AS (SELECT entity, count(*) AS shared FROM p WHERE item_key IN (SELECT item_key FROM f) AND entity <> (SELECT min(entity) FROM p) GROUP BY 1),
    b AS (SELECT s.entity, shared, items FROM s JOIN c ON s.entity = c.entity WHERE items >= {FLOOR} ORDER BY shared DESC, s.entity LIMIT {NEIGHBOURS}),
    n AS (SELECT entity, shared, items, false AS focus FROM b UNION ALL SELECT entity, items, items, true FROM c WHERE entity = (SELECT min(entity) FROM p))"""


def nodes(spark, d, m):
    """The focus (here the first entity by name) and its strongest neighbours."""
    focus = m.agg(F.min("entity").alias("focus"))
    counts = m.groupBy("entity").agg(F.count("*").alias("items"))
    of_focus = m.join(F.broadcast(focus), F.col("entity") == F.col("focus")).select("item_key")
    shared = m.join(of_focus, "item_key", "left_semi").groupBy("entity").agg(F.count("*").alias("shared"))
    known = shared.join(counts, "entity").join(F.broadcast(focus), F.col("entity") == F.col("focus"), "left")
    near = known.where(F.col("focus").isNull() & (F.col("items") >= FLOOR)).orderBy(F.desc("shared"), "entity").limit(NEIGHBOURS)
    return near.select("entity", "shared", "items", F.lit(False).alias("focus")).union(known.where("focus is not null").select("entity", "shared", "items", F.lit(True).alias("focus")))


@query(f"WITH {NODE_SQL} SELECT * FROM n")
def ego_nodes(spark, d):
    return nodes(spark, d, mentions(spark, d))


@query(f"WITH {NODE_SQL} SELECT x.entity AS source, y.entity AS target, count(*) AS weight FROM p x JOIN p y ON x.item_key = y.item_key AND x.entity < y.entity WHERE x.entity IN (SELECT entity FROM n) AND y.entity IN (SELECT entity FROM n) GROUP BY 1, 2")
def ego_edges(spark, d):
    m = mentions(spark, d)
    # at most NEIGHBOURS + 1 names: bounded by construction
    kept = m.join(F.broadcast(nodes(spark, d, m).select("entity")), "entity", "left_semi")
    left, right = kept.select("item_key", F.col("entity").alias("source")), kept.select("item_key", F.col("entity").alias("target"))
    return left.join(right, "item_key").where("source < target").groupBy("source", "target").agg(F.count("*").alias("weight"))


@query(f"""WITH {BASKET_SQL}, g AS (SELECT DISTINCT entity, item_key FROM p QUALIFY count(*) OVER (PARTITION BY entity) >= 2), w AS (SELECT x.entity, y.entity AS related, count(*) AS weight FROM g x JOIN g y ON x.item_key = y.item_key AND x.entity <> y.entity GROUP BY 1, 2)
           SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, related)::INTEGER AS place FROM w QUALIFY place <= 15""")
def related_entities(spark, d):
    """The 15 names that share most items with each name."""
    return related(mentions(spark, d), most=15, floor=2)


@query(f"""WITH {BASKET_SQL}, c AS (SELECT entity, count(*) AS items FROM p GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT p.entity, items, item_key, row_number() OVER (PARTITION BY p.entity ORDER BY item_key DESC) AS n FROM p JOIN c ON p.entity = c.entity)
           SELECT entity, items, string_agg(item_key::VARCHAR, ',' ORDER BY item_key DESC) AS newest FROM r WHERE n <= 20 GROUP BY 1, 2""")
def entity_dossier(spark, d):
    m = mentions(spark, d)
    counts = m.groupBy("entity").agg(F.count("*").alias("items")).where("items >= 2")
    w = Window.partitionBy("entity").orderBy(F.desc("item_key"))
    top = m.withColumn("n", F.row_number().over(w)).where("n <= 20").groupBy("entity").agg(F.reverse(F.array_sort(F.collect_list("item_key"))).alias("keys"))
    return counts.join(top, "entity").select("entity", "items", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("newest"))


PLACE_SQL = """n AS (SELECT n_nationkey AS site, n_name AS name, n_regionkey AS stage, (n_nationkey * 7 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 29 % 340 - 170)::DOUBLE AS lon FROM nation),
    a AS (SELECT site, name, stage, lat, lon, coalesce(s, 0) + coalesce(c, 0) AS activity FROM n LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON site = s_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON site = c_nationkey)"""


def places(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("stage"), (F.col("n_nationkey") * 7 % 120 - 60).cast("double").alias("lat"), (F.col("n_nationkey") * 29 % 340 - 170).cast("double").alias("lon"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.count("*").alias("s"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.count("*").alias("c"))
    return n.join(s, "site", "left").join(c, "site", "left").withColumn("activity", F.coalesce("s", F.lit(0)) + F.coalesce("c", F.lit(0))).drop("s", "c")


@query(f"WITH {PLACE_SQL} SELECT site, name, activity FROM a")
def place_counts(spark, d):
    return places(spark, d).select("site", "name", "activity")


ARC_SQL = PLACE_SQL + ", r AS (SELECT x.site AS source, y.site AS target, x.activity + y.activity AS activity, x.lat AS lat1, x.lon AS lon1, y.lat AS lat2, y.lon AS lon2 FROM a x JOIN a y ON y.stage = x.stage + 1)"


def arcs(spark, d):
    """Sites at adjacent stages: an equi-join on the stage."""
    p = places(spark, d)
    x = p.select(F.col("site").alias("source"), (F.col("stage") + 1).alias("stage"), F.col("activity").alias("xa"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    y = p.select(F.col("site").alias("target"), "stage", F.col("activity").alias("ya"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return x.join(y, "stage").select("source", "target", (F.col("xa") + F.col("ya")).alias("activity"), "lat1", "lon1", "lat2", "lon2")


@query(f"WITH {ARC_SQL} SELECT source, target, activity FROM r")
def supply_arcs(spark, d):
    return arcs(spark, d).select("source", "target", "activity")


@query(f"""WITH {ARC_SQL}, t AS (SELECT *, 2 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) AS g FROM r),
      u AS (SELECT *, unnest(CASE WHEN sin(g) = 0 THEN [0, 48] ELSE range(0, 49) END) AS step FROM t), v AS (SELECT *, CASE WHEN sin(g) = 0 THEN 1 - step / 48.0 ELSE sin((1 - step / 48.0) * g) / sin(g) END AS p, CASE WHEN sin(g) = 0 THEN step / 48.0 ELSE sin(step / 48.0 * g) / sin(g) END AS q FROM u),
      w AS (SELECT source, target, step, p * cos(radians(lat1)) * cos(radians(lon1)) + q * cos(radians(lat2)) * cos(radians(lon2)) AS x, p * cos(radians(lat1)) * sin(radians(lon1)) + q * cos(radians(lat2)) * sin(radians(lon2)) AS y, p * sin(radians(lat1)) + q * sin(radians(lat2)) AS z FROM v)
      SELECT source, target, step::INTEGER AS step, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon FROM w""")
def arc_paths(spark, d):
    rad = lambda c: F.radians(F.col(c))
    half = F.pow(F.sin((rad("lat2") - rad("lat1")) / 2), 2) + F.cos(rad("lat1")) * F.cos(rad("lat2")) * F.pow(F.sin((rad("lon2") - rad("lon1")) / 2), 2)
    t = arcs(spark, d).withColumn("g", 2 * F.asin(F.sqrt(half)))
    # equal or opposite ends have no single path: the ends alone
    flat = F.sin("g") == 0
    t = t.withColumn("step", F.explode(F.when(flat, F.array(F.lit(0), F.lit(48))).otherwise(F.sequence(F.lit(0), F.lit(48)))))
    along = F.col("step") / 48
    p = F.when(flat, 1 - along).otherwise(F.try_divide(F.sin((1 - along) * F.col("g")), F.sin("g")))
    q = F.when(flat, along).otherwise(F.try_divide(F.sin(along * F.col("g")), F.sin("g")))
    x = p * F.cos(rad("lat1")) * F.cos(rad("lon1")) + q * F.cos(rad("lat2")) * F.cos(rad("lon2"))
    y = p * F.cos(rad("lat1")) * F.sin(rad("lon1")) + q * F.cos(rad("lat2")) * F.sin(rad("lon2"))
    z = p * F.sin(rad("lat1")) + q * F.sin(rad("lat2"))
    return t.select("source", "target", "step", F.round(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), 4).alias("lat"), F.round(F.degrees(F.atan2(y, x)), 4).alias("lon"))


#: Places named in texts: term, place, confidence.
GAZETTEER = [("nation", "N", 0.7), ("license", "L", 0.9), ("apache", "L", 0.8), ("mail", "M", 0.6)]
GAZETTEER_SQL = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS place, {c}::DOUBLE * CASE WHEN contains(lower(split_part(text, chr(10), 1)), '{t}') THEN 1 ELSE 0.85 END AS confidence FROM documents WHERE contains(lower(text), '{t}')" for t, p, c in GAZETTEER)


@query(f"SELECT doc_id AS item_key, place, round(max(confidence), 6) AS confidence FROM ({GAZETTEER_SQL}) WHERE confidence >= 0.5 GROUP BY 1, 2")
def gazetteer_matches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"), F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    found = F.array_compact(F.array(*[F.when(F.col("t").contains(t), F.struct(F.lit(p).alias("place"), F.when(F.col("title").contains(t), c).otherwise(c * 0.85).alias("confidence"))) for t, p, c in GAZETTEER]))
    rows = docs.select(F.col("doc_id").alias("item_key"), F.explode(found).alias("m")).select("item_key", "m.place", "m.confidence")
    return rows.where("confidence >= 0.5").groupBy("item_key", "place").agg(F.round(F.max("confidence"), 6).alias("confidence"))
