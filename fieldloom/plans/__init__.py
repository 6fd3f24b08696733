"""Plans of the field engine."""
