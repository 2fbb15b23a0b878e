"""Spark building blocks: sources."""
