"""Operators for building training data: deduplication, mixing, packing, fingerprints, filters, token files and media.

Nothing else in the package imports this subpackage.
"""
