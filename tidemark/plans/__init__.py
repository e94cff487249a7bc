"""Whole pipelines: import, publish, board page, catalog, review, privacy gate."""
