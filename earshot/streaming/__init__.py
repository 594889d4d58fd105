"""Structured Streaming forms of the session and activity operators."""
