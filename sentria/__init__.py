"""Spark-native text forensics: documents -> sentences -> features -> scores -> reasons."""

__version__ = "0.1.0"
