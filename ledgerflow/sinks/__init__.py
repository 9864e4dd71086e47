"""Stored tables and sink functions."""
