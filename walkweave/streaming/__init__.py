"""Incremental upkeep of a walk store."""
