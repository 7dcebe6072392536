"""Spark-first analytics over per-subject event logs."""
