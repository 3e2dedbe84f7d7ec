"""Composed plans: the query catalogue and the end-to-end graph build."""
