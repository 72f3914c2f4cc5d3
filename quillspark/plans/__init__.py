"""Registered queries of the core."""
