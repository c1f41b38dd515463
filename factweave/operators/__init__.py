"""DataFrame operators of claim verification."""
