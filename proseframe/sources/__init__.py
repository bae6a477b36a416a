"""Sources of the text-quality engine."""
