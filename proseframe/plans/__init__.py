"""Plans of the text-quality engine."""
