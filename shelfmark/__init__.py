"""Catalog search, replica audit and cluster telemetry as Spark jobs."""

__version__ = "0.1.0"
