"""Text matching, record linkage and string analytics as Spark plans."""

__version__ = "0.1.0"
