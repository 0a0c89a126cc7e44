"""marketloom.streaming."""
