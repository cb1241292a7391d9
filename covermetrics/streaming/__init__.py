"""Structured Streaming jobs: document intake, alert windows, activity sessions."""
