"""Operators for building training data from an archive.

Nothing outside this package imports it; its queries are in ``llm.entries``.
"""
