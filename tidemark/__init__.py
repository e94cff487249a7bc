"""Tidemark: deadline boards and snapshot publication as Spark jobs."""
