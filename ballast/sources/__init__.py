"""Readers, writers and stored catalogues."""
