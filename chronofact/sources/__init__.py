"""Readers and parsers that feed the statement store."""
