"""Column helpers, scalar statistics and ordered aggregates."""
