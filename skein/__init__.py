"""Spark-first retrieval and corpus analytics."""
