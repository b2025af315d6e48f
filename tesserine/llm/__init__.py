"""Training-data operators: fingerprints, dedup, scoring, mixing and packing.

Nothing else in the library imports this subpackage.
"""
