"""kinquery: fact graphs, document corpora and evaluation analytics on PySpark."""

__version__ = "0.1.0"
