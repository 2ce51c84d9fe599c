"""Operators over logs, as DataFrame transformations."""
