"""Operators over streams of texts."""
