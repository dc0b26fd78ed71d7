"""weftline: curation of text and code corpora and evaluation analytics on Apache Spark."""

__version__ = "0.1.0"
