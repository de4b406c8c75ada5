"""Scores, overrides, ranked and paged feeds over orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.operators.versions import newest
from tidewatch.plans import query
from tidewatch.session import table

AT = "1998-08-02 00:00:00"
#: Half life in hours by beat (a small dimension, stated here).
HALF_LIVES = {"1-URGENT": 2000.0, "2-HIGH": 4000.0, "3-MEDIUM": 8000.0, "4-NOT SPECIFIED": 6000.0, "5-LOW": 12000.0}
HALF_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in HALF_LIVES.items()) + ") AS h(beat, hl)"
LATEST_SQL = """l AS (SELECT o_custkey AS item_key, o_orderpriority AS beat, o_totalprice AS score, o_orderdate AS computed_at FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
DECAY_SQL = f"pow(0.5, greatest(0, epoch(TIMESTAMP '{AT}') - epoch(computed_at)) / 3600 / hl)"
#: Pin rules: label, beat, least score, priority.
RULES = [("very large", "1-URGENT", 400000.0, 1), ("large", "2-HIGH", 350000.0, 2), ("large urgent", "1-URGENT", 300000.0, 3)]
RULE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, {p})" for a, b, c, p in RULES) + ") AS r(label, beat, least, priority)"


def latest(spark, d):
    """Latest score per (item, beat)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item_key"), F.col("o_orderpriority").alias("beat"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("computed_at"), "o_orderkey")
    return newest(o, ["item_key", "beat"], "computed_at", "o_orderkey").drop("o_orderkey")


def halves(spark):
    return F.broadcast(spark.createDataFrame(list(HALF_LIVES.items()), "beat string, hl double"))


def decayed(spark, d):
    return latest(spark, d).join(halves(spark), "beat").withColumn("decayed", F.round(F.col("score") * S.decay(F.col("computed_at"), AT, F.col("hl")), 6)).drop("hl")


@query(f"WITH {LATEST_SQL} SELECT * FROM l")
def latest_scores(spark, d):
    return latest(spark, d)


RANK_SQL = f"""{LATEST_SQL}, x AS (SELECT l.*, round(score * {DECAY_SQL}, 6) AS decayed FROM l JOIN {HALF_SQL} ON l.beat = h.beat),
    p AS (SELECT x.item_key, x.beat, min(priority) AS priority FROM x JOIN {RULE_SQL} ON x.beat = r.beat AND x.score >= r.least GROUP BY 1, 2),
    f AS (SELECT x.*, priority IS NOT NULL AS pinned, coalesce(priority, 999) AS priority FROM x LEFT JOIN p ON x.item_key = p.item_key AND x.beat = p.beat)"""


def pins(spark):
    return F.broadcast(spark.createDataFrame(RULES, "label string, rule_beat string, least double, rule_priority int"))


def ranked(spark, d):
    """Decayed scores with pins: the strongest rule that a row meets."""
    x = decayed(spark, d)
    met = x.join(pins(spark), (F.col("beat") == F.col("rule_beat")) & (F.col("score") >= F.col("least"))).groupBy("item_key", "beat").agg(F.min("rule_priority").alias("priority"))
    return x.join(met, ["item_key", "beat"], "left").withColumn("pinned", F.col("priority").isNotNull()).withColumn("priority", F.coalesce("priority", F.lit(999)))


@query(f"""WITH {RANK_SQL} SELECT item_key, score, computed_at, decayed, pinned, priority FROM f WHERE beat = '1-URGENT'
           ORDER BY pinned DESC, priority, decayed DESC, item_key LIMIT 200""")
def beat_ranking(spark, d):
    order = [F.desc("pinned"), "priority", F.desc("decayed"), "item_key"]
    return ranked(spark, d).where("beat = '1-URGENT'").drop("beat").orderBy(*order).limit(200)


@query(f"""WITH {LATEST_SQL} SELECT item_key, beat, array_to_string(list(label ORDER BY priority, label), ',') AS labels, min(priority) AS priority
           FROM l JOIN {RULE_SQL} USING (beat) WHERE score >= least GROUP BY 1, 2""")
def overrides(spark, d):
    met = latest(spark, d).join(pins(spark), (F.col("beat") == F.col("rule_beat")) & (F.col("score") >= F.col("least")))
    return met.groupBy("item_key", "beat").agg(F.array_sort(F.collect_list(F.struct("rule_priority", "label"))).alias("m")).select("item_key", "beat", F.array_join("m.label", ",").alias("labels"), F.col("m")[0]["rule_priority"].alias("priority"))


BEST_SQL = RANK_SQL + ", b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY decayed DESC, beat) = 1)"


def best(spark, d):
    """Best beat per item by decayed score; ties to the first name."""
    return newest(ranked(spark, d).withColumn("_back", F.translate("beat", "123456789", "987654321")), ["item_key"], "decayed", "_back").drop("_back")


@query(f"WITH {BEST_SQL} SELECT item_key, beat, decayed FROM b")
def best_beat(spark, d):
    return best(spark, d).select("item_key", "beat", "decayed")


FEED_COLUMNS = ["item_key", "beat", "decayed", "pinned", "priority"]


def page(feed, size, after=None):
    """One page in feed order, strictly after the cursor (pinned, priority, decayed, item_key)."""
    if after:
        pinned, priority, score, key = after
        unpinned, rank = (~F.col("pinned")).cast("int"), int(not pinned)
        later = (unpinned > rank) | ((unpinned == rank) & ((F.col("priority") > priority) | ((F.col("priority") == priority) & ((F.col("decayed") < score) | ((F.col("decayed") == score) & (F.col("item_key") < key))))))
        feed = feed.where(later)
    return feed.orderBy(F.desc("pinned"), "priority", F.desc("decayed"), F.desc("item_key")).limit(size)


@query(f"WITH {BEST_SQL} SELECT item_key, beat, decayed, pinned, priority FROM b ORDER BY pinned DESC, priority, decayed DESC, item_key DESC LIMIT 50")
def feed_page(spark, d):
    return page(best(spark, d).select(*FEED_COLUMNS), 50)


@query(f"WITH {BEST_SQL} SELECT item_key, beat, decayed, pinned, priority FROM b ORDER BY pinned DESC, priority, decayed DESC, item_key DESC LIMIT 50 OFFSET 50")
def feed_next_page(spark, d):
    """The rows behind the last one of the first page, whose key is a scalar of the same plan."""
    feed = best(spark, d).select(*FEED_COLUMNS)
    key = F.struct((~F.col("pinned")).cast("int"), "priority", -F.col("decayed"), -F.col("item_key"))
    return page(feed.where(key > page(feed, 50).agg(F.max(key)).scalar()), 50)


@query("""WITH s AS (SELECT c_custkey AS item_key, c_mktsegment AS beat, count(o_orderkey) AS n, c_acctbal AS bal FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
      m AS (SELECT *, greatest(0, least(1, (0.1 + (item_key % 20) * 0.1 - 0.1) / 1.9)) AS w, greatest(0, least(1, log2(greatest(n, 1)) / 3)) AS c,
                   greatest(0.05, least(3, 1 + 0.5 * (bal > 5000)::INT - 0.8 * (bal < 0)::INT)) AS k FROM s)
      SELECT item_key, beat, round((0.6 * c + 0.4 * w) * 10 * k, 6) AS signal_score, round((0.3 * c + 0.7 * w) * 10 * k, 6) AS read_score,
             round((0.6 * c + 0.4 * w) * 10 * k, 6) >= 8 AND round((0.3 * c + 0.7 * w) * 10 * k, 6) >= 6 AS high_on_both FROM m""")
def mechanical_scores(spark, d):
    sizes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_key")).agg(F.count("*").alias("n"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_key"), F.col("c_mktsegment").alias("beat"), F.col("c_acctbal").alias("bal")).join(sizes, "item_key", "left")
    w, c = S.source_weight(0.1 + (F.col("item_key") % 20) * 0.1), S.cluster_size(F.coalesce("n", F.lit(0)))
    k = S.interest_multiplier((F.col("bal") > 5000).cast("int"), (F.col("bal") < 0).cast("int"))
    out = items.select("item_key", "beat", F.round((0.6 * c + 0.4 * w) * 10 * k, 6).alias("signal_score"), F.round((0.3 * c + 0.7 * w) * 10 * k, 6).alias("read_score"))
    return out.withColumn("high_on_both", (F.col("signal_score") >= 8) & (F.col("read_score") >= 6))


@query(f"""WITH {LATEST_SQL}, k AS (SELECT c_custkey AS item_key, beat FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS beat FROM orders))
           SELECT k.item_key, count(*) AS beats_due FROM k WHERE NOT EXISTS
           (SELECT 1 FROM l WHERE l.item_key = k.item_key AND l.beat = k.beat AND l.computed_at >= TIMESTAMP '1995-01-01') GROUP BY k.item_key""")
def scoring_due(spark, d):
    beats = table(spark, d, "orders").agg(F.collect_set("o_orderpriority")).scalar()  # an enumeration
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("item_key"), beats.alias("beats")).select("item_key", F.explode("beats").alias("beat"))
    done = latest(spark, d).where(F.col("computed_at") >= F.lit("1995-01-01").cast("timestamp"))
    return keys.join(done, ["item_key", "beat"], "left_anti").groupBy("item_key").agg(F.count("*").alias("beats_due"))


@query(f"""WITH {RANK_SQL}, e AS (SELECT f.* FROM f JOIN customer ON c_custkey = item_key WHERE c_mktsegment = 'BUILDING' AND computed_at <= TIMESTAMP '1997-06-01')
           SELECT item_key, beat, decayed, computed_at FROM e WHERE decayed >= 1000 QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY decayed DESC, beat) = 1""")
def items_for_entity(spark, d):
    named = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("item_key"))
    rows = ranked(spark, d).join(named, "item_key", "left_semi").where((F.col("computed_at") <= F.lit("1997-06-01").cast("timestamp")) & (F.col("decayed") >= 1000))
    w = Window.partitionBy("item_key").orderBy(F.desc("decayed"), "beat")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("item_key", "beat", "decayed", "computed_at")


@query(f"""WITH {RANK_SQL}, b AS (SELECT beat, item_key, decayed, row_number() OVER (PARTITION BY beat ORDER BY decayed DESC, item_key) AS n FROM f WHERE NOT pinned),
           c AS (SELECT beat, count(*) AS ranked, count(*) FILTER (pinned) AS flagged FROM f GROUP BY beat)
           SELECT b.beat, n::INTEGER AS place, item_key, decayed, ranked, flagged FROM b JOIN c ON b.beat = c.beat WHERE n <= 5""")
def daily_digest(spark, d):
    f = ranked(spark, d)
    w = Window.partitionBy("beat").orderBy(F.desc("decayed"), "item_key")
    top = f.where("not pinned").withColumn("place", F.row_number().over(w)).where("place <= 5").select("beat", "place", "item_key", "decayed")
    counts = f.groupBy("beat").agg(F.count("*").alias("ranked"), F.count_if("pinned").alias("flagged"))
    return top.join(F.broadcast(counts), "beat")


@query("""SELECT o_orderpriority AS beat, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN min(last_ok) END AS refreshed_at, count(*) AS sources
          FROM (SELECT o_orderpriority, o_orderstatus, o_custkey % 50 AS source, max(o_orderdate) AS last_ok FROM orders GROUP BY ALL) GROUP BY 1""")
def beat_refresh(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 50).alias("source")).agg(F.max("o_orderdate").alias("last_ok"))
    return o.groupBy(F.col("o_orderpriority").alias("beat")).agg(F.when(F.count_if(F.col("o_orderstatus") == "P") == 0, F.min("last_ok")).alias("refreshed_at"), F.count("*").alias("sources"))
