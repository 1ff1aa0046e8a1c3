"""Structured streams: windows, sessions, keyed state, change logs into collections."""
