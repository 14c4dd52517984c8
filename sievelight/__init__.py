"""Sift large collections of image files and their metadata as Spark tables."""

__version__ = "0.1.0"
