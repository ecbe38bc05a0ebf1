"""Keyed state kept from a stream of changes."""
