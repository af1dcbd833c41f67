"""Ridgeline: terrain and route analytics as Spark DataFrame operations."""
