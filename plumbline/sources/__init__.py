"""Readers, writers, merging and the table catalog."""
