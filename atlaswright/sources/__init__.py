"""Scans: documents and files to tables, and sinks back to them."""
