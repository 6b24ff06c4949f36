"""Declared facts: wire layouts, dimensions, send policies and source registry."""
