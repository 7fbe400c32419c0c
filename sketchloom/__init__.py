"""Similarity and containment analytics for large sets, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
