"""Linking a stream of new records against a static index."""
