"""Relational operators over the record, intervals, vectors and metrics."""
