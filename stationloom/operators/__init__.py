"""The quality-control levels."""
