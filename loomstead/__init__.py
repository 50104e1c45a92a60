"""Spark-first analytics over registry-style research data."""
