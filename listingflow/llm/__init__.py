"""Operators for training-data pipelines, each a Spark job over a whole table.

Nothing else in the package imports this one; its queries are in ``llm.catalog``.
"""
