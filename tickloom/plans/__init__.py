"""Trade-tape plans."""
