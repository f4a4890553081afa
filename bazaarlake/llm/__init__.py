"""Operators for preparing text to train language models. Nothing else in the library imports this package."""
