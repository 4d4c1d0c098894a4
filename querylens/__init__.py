"""Spark-native investigation of PostgreSQL server logs."""

__version__ = "0.1.0"
