"""Composed reports and the query registry."""
