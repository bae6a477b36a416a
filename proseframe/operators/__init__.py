"""Operators of the text-quality engine."""
