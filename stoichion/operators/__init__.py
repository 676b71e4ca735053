"""Relational operators over reaction-network tables."""
