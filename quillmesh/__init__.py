"""Spark-first engine for privacy-preserving text processing at corpus scale."""

__version__ = "0.1.0"
