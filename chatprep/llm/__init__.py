"""Operators that make training data out of a raw corpus."""
