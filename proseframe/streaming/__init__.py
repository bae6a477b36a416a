"""Streaming of the text-quality engine."""
