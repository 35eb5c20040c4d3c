"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries and their SQL
are in :mod:`lodestone.llm.registry`.
"""
