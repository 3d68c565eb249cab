"""Tessarine: structural retrieval, graph analytics and context packing on Apache Spark."""

__version__ = "0.1.0"
