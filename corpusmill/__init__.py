"""Corpus retrieval and analytics as PySpark jobs."""
