"""Results, chains and reports."""
