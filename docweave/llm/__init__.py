"""Operators for large training-data pipelines.

Nothing outside this folder imports it.  Each module holds one operator;
``queries`` registers the thin queries over the test tables.
"""
