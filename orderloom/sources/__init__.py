"""Typed readers, receipt tables and sinks."""
