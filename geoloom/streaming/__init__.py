"""Spark building blocks: streaming."""
