"""Recorded captures as tables."""
