"""Spark-native curation and evaluation of GPS-tagged image collections."""

__version__ = "0.1.0"
