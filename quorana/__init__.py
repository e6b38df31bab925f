"""Spark-first analytics over rater consensus, text provenance and evidence quality."""

__version__ = "0.1.0"
