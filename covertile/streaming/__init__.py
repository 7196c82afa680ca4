"""Structured Streaming forms of the position windows and gap sessions."""
