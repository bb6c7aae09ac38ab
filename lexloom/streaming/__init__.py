"""Encoding of streams."""
