"""The queries, and the same in SQL."""
