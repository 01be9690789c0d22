"""Operators for preparing text corpora for language models. Nothing else in the package imports this."""
