"""Relational operators on coded tables."""
