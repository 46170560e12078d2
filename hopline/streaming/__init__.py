"""Chunked loading of arriving files."""
