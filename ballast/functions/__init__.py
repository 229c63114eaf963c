"""Scalar column functions; each returns a built-in expression."""
