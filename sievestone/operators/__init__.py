"""Operators on DataFrames, set at a time over all queries of a batch."""
