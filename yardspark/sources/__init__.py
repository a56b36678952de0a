"""Readers and writers of the yard's tables and files."""
