"""Retrieval, evaluation and corpus preparation on Spark."""
