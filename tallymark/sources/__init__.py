"""Readers, writers and catalog views."""
