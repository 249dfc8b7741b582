"""Decoding and validation of weakly typed tables, expressed as Spark column expressions."""

__version__ = "0.1.0"
