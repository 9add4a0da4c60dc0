"""Readers, load checks and stored runs."""
