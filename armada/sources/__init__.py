"""Readers of the input tables and writers of results."""
