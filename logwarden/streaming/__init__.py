"""Structured Streaming twins of the operators."""
