"""Readers and writers of series tables."""
