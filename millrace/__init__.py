"""Millrace: an analytics engine for organisational activity metrics, written for PySpark."""
