"""Lookup requests as a stream."""
