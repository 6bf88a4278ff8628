"""Whole queries: the public interface and the query catalogue."""
