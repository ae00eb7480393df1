"""Where source text comes from."""
