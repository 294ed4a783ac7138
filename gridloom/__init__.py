"""Distributed dense and sparse linear algebra over Spark tables."""

__version__ = "0.1.0"
