"""Stateless use on streams."""
