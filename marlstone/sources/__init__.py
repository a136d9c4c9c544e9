"""Readers with declared schemas: nothing is inferred, and what does not fit is an error or a reason."""
