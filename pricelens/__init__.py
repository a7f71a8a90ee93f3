"""pricelens: a Spark-native engine for retail price comparison data."""

__version__ = "0.1.0"
