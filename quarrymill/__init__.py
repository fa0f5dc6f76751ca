"""Spark-first catalog analytics and corpus processing."""
