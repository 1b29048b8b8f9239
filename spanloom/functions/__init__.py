"""Aggregates for merge, map and partition, ordered by the rows' position."""
from .aggs import concat, first, last, values, values_unique

__all__ = ["concat", "first", "last", "values", "values_unique"]
