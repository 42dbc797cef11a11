"""Full-text search, faceting and training-data preparation on Spark."""
