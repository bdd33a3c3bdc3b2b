"""Readers and writers of the catalog and of telemetry."""
