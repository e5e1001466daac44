"""Readers of recordings, text profiles and object files."""
