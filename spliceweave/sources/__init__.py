"""Readers and writers of the interchange files."""
