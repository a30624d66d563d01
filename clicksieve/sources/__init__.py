"""Readers, writers, inline relations and adapters to the log layout."""
