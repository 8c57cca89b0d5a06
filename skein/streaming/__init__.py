"""Streaming forms of the logs."""
