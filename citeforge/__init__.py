"""Spark-native engine for auditing how well generated answers are backed by cited evidence."""

__version__ = "0.1.0"
