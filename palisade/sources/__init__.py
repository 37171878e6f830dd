"""Readers, writers and adapters that shape given tables into the domain tables."""
