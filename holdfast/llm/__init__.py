"""Operators for building training data. Nothing else in the package imports this folder."""
