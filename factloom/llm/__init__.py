"""Training-data operators: deduplication, filtering, mixing, scoring, counting.

Nothing else in the library imports this subpackage.
"""
