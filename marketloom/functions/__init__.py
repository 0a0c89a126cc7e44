"""marketloom.functions."""
