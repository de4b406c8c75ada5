"""All queries of the engine by name, and the SQL that states them."""

from tidewatch.plans import ORACLE_SQL, QUERIES, cards, content, detail, extraction, graphs, intake, monitor, operations, ranking, reports, text, versions  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
