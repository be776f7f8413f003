"""Streams of test strings."""
