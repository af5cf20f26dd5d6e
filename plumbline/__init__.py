"""Leakage-safe tabular regression experiments as Spark jobs."""

SEED = 42
