"""Trade-tape streaming."""
