"""Functions of the field engine."""
