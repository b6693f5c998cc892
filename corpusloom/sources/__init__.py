"""Readers and keyed lookups."""
