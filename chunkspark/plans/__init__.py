"""Queries and pipelines that put operators together."""
