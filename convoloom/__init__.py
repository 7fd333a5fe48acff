"""Convoloom: a PySpark-native engine for archives of assistant conversations."""

__version__ = "0.1.0"
