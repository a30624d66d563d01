"""Structured Streaming forms of the detectors and of the alert table."""
