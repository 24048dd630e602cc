"""Curation of multimodal datasets with Spark DataFrames."""

__version__ = "0.1.0"
