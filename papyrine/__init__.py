"""Spark-first engine for document collections: caching, dedup, ranking, entities, graphs, evaluation."""
