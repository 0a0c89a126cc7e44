"""marketloom.sources."""
