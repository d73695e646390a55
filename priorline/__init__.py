"""Incident-history analytics on Spark: strictly-prior features, reports and models."""

__version__ = "0.1.0"
