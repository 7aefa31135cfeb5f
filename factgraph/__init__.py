"""A PySpark engine for evidence-backed system maps: typed facts, provenance, and graph questions over DataFrames."""

__version__ = "0.1.0"
