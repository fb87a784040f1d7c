"""Structured Streaming variants of two batch operators."""
