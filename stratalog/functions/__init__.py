"""Scalar functions: keys and names, record framing, payload checks."""
