"""Operators for text corpora: extraction, scans, packing, deduplication, search, scoring and sharding.

Nothing outside this package imports it.  ``queries`` holds the registered queries; every other module holds one
operator with its own interface.
"""
