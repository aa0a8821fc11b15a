"""Spark-native operators over collections of web and text evidence."""

__version__ = "0.1.0"
