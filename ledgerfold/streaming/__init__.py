"""Structured Streaming apply."""
