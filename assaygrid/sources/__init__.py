"""Readers: base tables, hit tables with their validation, region sets."""
