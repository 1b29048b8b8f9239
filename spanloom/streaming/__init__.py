"""Interval verbs on streams."""
from .overlap import merge_stream, overlap_stream

__all__ = ["merge_stream", "overlap_stream"]
