"""Expressions that the engine's SQL shares between dialects."""
