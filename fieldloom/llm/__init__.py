"""Training-data operators: tokenising, deduplication, extraction, archives, filtering, packing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; ``registry`` holds the registered queries.
"""
