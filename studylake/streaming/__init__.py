"""Structured Streaming entry points for exports that keep arriving."""
