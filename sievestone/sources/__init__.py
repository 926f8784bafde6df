"""Readers and writers: source trees, JSON lines, CSV, the index tables and their upkeep."""
