"""Whole jobs, and the query catalogue over the given tables."""
