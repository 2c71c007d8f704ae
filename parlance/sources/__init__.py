"""Readers and writers, and the projection of generic tables onto the record."""
