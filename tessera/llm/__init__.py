"""Training-data operators: deduplication, decontamination, quality, mixing, privacy and formatting.

Nothing else in the library imports this subpackage.
"""
