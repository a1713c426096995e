"""Corpus-scale linguistic analysis as ordinary Spark DataFrame jobs."""

__version__ = "0.1.0"
