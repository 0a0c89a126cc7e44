"""marketloom.plans."""
