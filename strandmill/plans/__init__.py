"""Whole comparisons and the registered queries with their SQL oracles."""
