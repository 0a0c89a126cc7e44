"""marketloom.operators."""
