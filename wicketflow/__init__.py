"""Spark-first analytics over ball-by-ball sports data."""
