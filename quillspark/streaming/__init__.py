"""Streams of evidence."""
