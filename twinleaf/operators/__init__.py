"""Relational building blocks: parsing, pairing, plugins."""
