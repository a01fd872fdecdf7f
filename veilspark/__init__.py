"""Veilspark: personal-data detection, tokenisation and audit as Spark DataFrame operators."""

__version__ = "0.1.0"
