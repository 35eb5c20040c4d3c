"""Readers and writers of retrieval files."""
