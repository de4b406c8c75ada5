"""Integrity rules as violations: one row per (rule, key); the lag rules need one window by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every broken rule; a rule that is null for a row is not broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).alias("key"))


def call_rules() -> dict[str, Column]:
    """Rules of one logged model call."""
    both = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    gap = F.unix_seconds(F.try_to_timestamp("called_at")) - F.unix_seconds(F.col("usage_day").cast("timestamp"))
    return {
        "instant not canonical": ~F.col("called_at").rlike(INSTANT),
        "day not plausible": (gap <= -86400) | (gap >= 2 * 86400),
        "reason against status": F.col("unavailable_reason").isNull() != (F.col("status") == "ok"),
        "counted flag": F.col("tokens_counted") != both,
        "total against count": F.col("total_tokens").isNull() == F.col("tokens_counted"),
        "total is not the sum": F.col("total_tokens") != F.col("input_tokens") + F.col("output_tokens"),
        "amount against measure": F.col("amount_usd").isNull() == F.col("cost_measured"),
    }


def answer_violations(history: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Rules between successive records of a key, in ``seq`` order: time moves on, an answer is never lost."""
    w = Window.partitionBy(*keys).orderBy("seq")
    seen = history.withColumn("_at", F.lag("attempted_at").over(w)).withColumn("_outcome", F.lag("outcome").over(w))
    rules = {
        "attempt not later": F.col("attempted_at") <= F.col("_at"),
        "answer lost": F.col("outcome").isNull() & F.col("_outcome").isNotNull(),
    }
    return violations(seen, key, rules)
