"""Trade-tape operators."""
