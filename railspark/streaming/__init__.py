"""Structured Streaming variants of the stateless cleaning pipelines."""
