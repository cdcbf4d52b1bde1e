"""Readers and writers: source files and contract tables."""
