"""Readers and writers with a fixed contract."""
