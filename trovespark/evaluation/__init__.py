"""Retrieval quality."""
