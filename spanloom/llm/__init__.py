"""Training-data operators: near duplicates, decontamination, packing, quality, PII and token output.

Nothing else in the library imports this subpackage.
"""
