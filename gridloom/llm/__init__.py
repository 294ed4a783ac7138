"""Operators of a training-data pipeline: mixing, token output, cleaning,
near-duplicate joins, classifiers and vector search over Spark tables.

Nothing outside this subpackage imports it.
"""
