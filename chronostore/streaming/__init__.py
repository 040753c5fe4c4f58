"""Continuous replay with Structured Streaming."""
