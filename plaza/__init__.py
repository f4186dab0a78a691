"""plaza: a PySpark-native analytics engine for social-interaction data."""

__version__ = "0.1.0"
