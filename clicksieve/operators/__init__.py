"""Relational operators: detection, scoring, alerts, evaluation and reports."""
