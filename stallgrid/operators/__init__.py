"""Operators of the catalog engine."""
