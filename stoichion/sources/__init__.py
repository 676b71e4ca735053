"""Readers and writers of models, mappings and results."""
