"""Readers for tracker tables, declaration documents, settings and lookups."""
