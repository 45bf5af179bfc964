"""Operators on snapshots: scope filters, definition columns and drift."""
