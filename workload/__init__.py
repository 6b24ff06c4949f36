"""Binding of the shipped tables to telemetry inputs, jobs over them, and reference SQL."""
