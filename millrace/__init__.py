"""millrace: governed, bounded data queries on Apache Spark."""

__version__ = "0.1.0"
