"""Readers that turn files into documents."""
