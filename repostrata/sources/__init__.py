"""Readers, writers and adapters for the canonical tables."""
