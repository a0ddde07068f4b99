"""Queries of the library and their SQL."""
