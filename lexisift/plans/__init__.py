"""From requests to column expressions."""
