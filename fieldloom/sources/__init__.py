"""Sources of the field engine."""
