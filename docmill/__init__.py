"""docmill: text, retrieval and quality-audit operators as Spark DataFrame functions."""

__version__ = "0.1.0"
