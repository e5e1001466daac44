"""stackloom: a PySpark-native engine for profile analytics."""

__version__ = "0.1.0"
