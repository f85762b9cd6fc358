"""Readers and writers of documents."""
