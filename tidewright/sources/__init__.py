"""Formats, mapping, sources, sinks and error handling."""
