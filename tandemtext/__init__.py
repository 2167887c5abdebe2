"""Parallel-corpus preparation and translation-quality analytics as Spark jobs."""
