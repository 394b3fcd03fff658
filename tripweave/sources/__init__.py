"""Readers, lookup sources, writers, and the adapter for the star-schema test tables."""
