"""A PySpark-native engine for ingesting, indexing and searching document collections."""

__version__ = "0.1.0"
