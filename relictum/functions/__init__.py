"""Column builders; no session, no I/O."""
