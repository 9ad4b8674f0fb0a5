"""Readers, sinks, schemas and the mapping of the test tables."""
