"""Sinks: SQL text, flow dumps, notifications."""
