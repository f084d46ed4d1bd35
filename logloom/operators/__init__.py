"""Relational operators over message tables."""
