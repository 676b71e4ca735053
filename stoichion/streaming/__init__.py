"""Incremental loading and matching of model files."""
