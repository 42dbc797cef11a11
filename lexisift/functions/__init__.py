"""Column builders: text analysis and value coercion."""
