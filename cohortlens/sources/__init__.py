"""Readers, writers, completeness checks and stage reuse."""
