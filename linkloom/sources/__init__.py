"""Readers and writers of the linkage tables."""
