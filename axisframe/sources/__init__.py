"""Readers, writers and constructors."""
