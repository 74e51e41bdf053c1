"""Catalens: metadata-catalog and time-to-event analytics as Spark DataFrame operations."""
