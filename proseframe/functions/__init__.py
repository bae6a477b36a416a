"""Functions of the text-quality engine."""
