"""Operators over assets, chunks, vectors and requests."""
