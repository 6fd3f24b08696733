"""Streaming of the field engine."""
