"""Streams: files that arrive, taken once."""
