"""Scans, sinks and run records of linkage data."""
