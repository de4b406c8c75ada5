"""Repositories with everything that is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans import ORACLE_SQL, query
from tidewatch.plans.detail import suppressed_repos, velocity_by_item
from tidewatch.plans.monitor import discussion_overlaps
from tidewatch.session import table


@query(f"""WITH c AS (SELECT c_custkey AS item_key, lower(replace(c_mktsegment, ' ', '-')) || '/repo-' || c_custkey AS repo_key, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_acctbal >= 0 THEN 'present' ELSE 'absent' END AS readme FROM customer)
      SELECT c.item_key, c.repo_key, readme, status, stars_per_day, coalesce(mentions, 0) AS mentions, coalesce(strength, 0)::DOUBLE AS strength, reasons FROM c LEFT JOIN ({ORACLE_SQL["velocity_by_item"]}) v ON v.item_key = c.item_key LEFT JOIN ({ORACLE_SQL["discussion_overlaps"]}) o ON o.repo_key = c.repo_key LEFT JOIN ({ORACLE_SQL["suppressed_repos"]}) s ON s.repo_id = c.item_key""")
def repo_cards(spark, d):
    """Reference, growth, discussion, readme (unknown where none was asked for) and reasons of suppression, by repository."""
    k = F.col("c_custkey")
    readme = F.when(k % 4 == 0, "unknown").when(F.col("c_acctbal") >= 0, "present").otherwise("absent")
    c = table(spark, d, "customer").select(k.alias("item_key"), F.concat(F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit("-"))), F.lit("/repo-"), k).alias("repo_key"), readme.alias("readme"))
    v = velocity_by_item(spark, d).select("item_key", "status", "stars_per_day")
    o = discussion_overlaps(spark, d).select("repo_key", "mentions", "strength")
    s = suppressed_repos(spark, d).withColumnRenamed("repo_id", "item_key")
    rows = c.join(v, "item_key", "left").join(o, "repo_key", "left").join(s, "item_key", "left")
    return rows.select("item_key", "repo_key", "readme", "status", "stars_per_day", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("strength", F.lit(0.0)).alias("strength"), "reasons")
