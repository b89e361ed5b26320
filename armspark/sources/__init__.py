"""Scans, sinks and the experiment view over star-schema tables."""
