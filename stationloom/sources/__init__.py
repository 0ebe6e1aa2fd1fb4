"""Tables and files as station panels."""
