"""Readers and writers of models, clouds and photo metadata."""
