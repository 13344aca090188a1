"""Training-data operators: filtering, deduplication, mixing, packing and formatting.

Nothing outside this subpackage imports it.
"""
