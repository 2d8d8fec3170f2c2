"""Training-data operators: deduplication, filtering, mixing, sharding and token output.

Nothing else in the library imports this subpackage.
"""
