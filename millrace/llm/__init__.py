"""Operators of a large training-data pipeline.

Nothing else in the library imports this subpackage; its queries and their
SQL are in :mod:`millrace.llm.queries`.
"""
