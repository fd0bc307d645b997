"""Sillage: a PySpark-native engine that turns crawled web pages into a searchable, answerable corpus."""

__version__ = "0.1.0"
