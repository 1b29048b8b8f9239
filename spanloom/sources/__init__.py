"""Readers of interval formats."""
