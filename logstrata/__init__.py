"""Commit-history analytics expressed as Spark DataFrame jobs."""
