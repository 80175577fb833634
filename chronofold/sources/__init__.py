"""Readers and writers of notes, line files and evidence bundles."""
