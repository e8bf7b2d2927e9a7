"""Readers of landed files, tables and imports."""
