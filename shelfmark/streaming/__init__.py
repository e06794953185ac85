"""Structured Streaming versions of the progress and registry operators."""
