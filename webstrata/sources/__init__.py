"""Readers and writers for recorded web data."""
