"""Readers, writers and parsers of the formats reviews arrive in."""
