"""Operators that prepare training data: mixing, deduplication, packing, counting, judging.

Nothing else in the library imports this subpackage.
"""
