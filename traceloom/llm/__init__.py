"""Training-data preparation operators: filtering, deduplication, tokenisation, packing.

Self-contained: no other part of the library imports this subpackage.
"""
