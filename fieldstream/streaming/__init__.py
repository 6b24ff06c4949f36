"""Structured Streaming forms of the receiving path and of the stateful operators."""
