"""Training-data operators: filters, deduplication, mixing, sharding, packing.

Nothing outside this subpackage imports it.
"""
