"""Sinks: applying a plan and exporting a snapshot."""
