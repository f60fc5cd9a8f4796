"""Spark-first table engine."""
