"""Training-data operators: near-duplicates, retrieval, mixing, packing, formatting, scoring.

Nothing outside this subpackage imports it.
"""
