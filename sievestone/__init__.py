"""Set-at-a-time retrieval, ranking and evaluation analytics on PySpark."""

__version__ = "0.1.0"
