"""Streaming forms of append-only tables."""
