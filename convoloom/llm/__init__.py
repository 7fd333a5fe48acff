"""Operators for training data out of conversations and documents. Nothing outside this package imports it."""
