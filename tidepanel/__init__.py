"""Spark-first analytics over panels of regularly sampled time series."""
