"""Composite reports and the query registry."""
