"""Joining, reshaping and publishing tables and streams with PySpark."""
