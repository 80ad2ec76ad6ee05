"""Relational operators over triples and walks."""
