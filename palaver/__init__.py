"""Session-payload analytics on Spark: tables, operators, sources, streaming."""

__version__ = "0.1.0"
