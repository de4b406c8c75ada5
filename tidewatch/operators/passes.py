"""Passes that write their rows and count their outcomes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.session import local_rows


def counted_write(rows: DataFrame, path: str, kept: Column, counts: dict[str, Column], mode: str = "overwrite") -> dict[str, int]:
    """Writes the rows that are ``kept`` and returns the aggregates ``counts`` over all rows, from one scan.

    The counts are observed while the rows go by, so no second pass and no cache is needed; a
    row that a count finds bad is left out by ``kept`` alone.
    """
    seen = Observation()
    watched = rows.observe(seen, *[c.alias(name) for name, c in counts.items()])
    watched.where(F.coalesce(kept, F.lit(False))).write.mode(mode).parquet(path)
    return {name: int(seen.get[name] or 0) for name in counts}


def as_row(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """The counts of a pass as a table of one row."""
    return local_rows(rows.sparkSession, [tuple(counts.values())], ", ".join(f"{name} long" for name in counts))
