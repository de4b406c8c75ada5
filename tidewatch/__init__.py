"""Spark-native feed intelligence: versioned items, ranking, graphs, digests and search as DataFrame jobs."""
