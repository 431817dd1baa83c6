"""Operators of a training-data pipeline: packing, quality, mixing, de-duplication, search,
web archives, licence scans, fingerprints, personal data and sharding.

Nothing else in the library imports this subpackage.
"""
