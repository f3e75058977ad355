"""Readers, writers and graphs made from tables."""
