"""The catalogue of named queries with their SQL equivalents."""
