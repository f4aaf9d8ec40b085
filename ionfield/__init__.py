"""ionfield: a PySpark-native engine for spatially resolved measurement tables."""

__version__ = "0.1.0"
