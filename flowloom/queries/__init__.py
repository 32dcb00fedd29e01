"""Registered queries of the core library with their SQL checks."""
