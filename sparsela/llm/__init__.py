"""Operators for the preparation of language-model training data.

Nothing outside this folder imports it. Every operator takes and returns
DataFrames; the thin contract queries are in ``queries.py``.
"""
