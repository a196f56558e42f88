"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the queries over the test tables
live in :mod:`tracepairs.llm.queries`.
"""
