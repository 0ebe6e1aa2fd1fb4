"""Levels on unbounded input."""
