"""The analyses. Every function takes a DataFrame and column names and returns a DataFrame."""
