"""Queries, policy, sinks and test corpora."""
