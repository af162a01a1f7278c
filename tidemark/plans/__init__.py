"""Queries as values: matchers, selectors, query descriptions."""
