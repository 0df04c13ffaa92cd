"""Readers of agent session logs."""
