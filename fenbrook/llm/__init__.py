"""Training-data operators: sharding, filtering, deduplication, packing, tokens.

Each module holds one operator; ``queries`` binds them to the given tables.
Nothing outside this subpackage imports it.
"""
