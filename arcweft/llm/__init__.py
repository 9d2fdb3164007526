"""Training-data operators: mixing, fingerprints, extraction, classification, packing, deduplication.

Nothing else in the library imports this subpackage.
"""
