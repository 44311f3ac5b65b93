"""Readers, writers and the standard views over the test tables."""
