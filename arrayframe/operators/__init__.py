"""Selections, statistics, range queries, reshaping and comparison, as DataFrame transformations."""
