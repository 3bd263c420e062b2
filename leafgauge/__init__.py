"""Region-level text quality on paged documents, expressed as Spark plans."""

__version__ = "0.1.0"
