"""Incremental inference."""
