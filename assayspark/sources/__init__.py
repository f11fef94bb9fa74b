"""Readers, column resolution and sinks."""
