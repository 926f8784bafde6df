"""Append-only tables as streams."""
