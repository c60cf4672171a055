"""Sampled-signal analytics as Spark DataFrame operators."""
