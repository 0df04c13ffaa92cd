"""Streaming forms of change detection and delivery."""
