"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage, and it may be removed
without harm to the rest.
"""
