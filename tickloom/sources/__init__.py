"""Trade-tape sources."""
