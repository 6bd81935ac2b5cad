"""Training-data operators: deduplication, search, packing, extraction, mixing, formatting.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
