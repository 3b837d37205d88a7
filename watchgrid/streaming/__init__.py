"""Structured Streaming twins of the batch operators: the same rows in, in whatever order and portions, give the same state."""
