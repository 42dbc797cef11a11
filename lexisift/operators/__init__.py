"""What follows the match: sorting, paging, projection, highlighting and aggregation."""
