"""Operators of the field engine."""
