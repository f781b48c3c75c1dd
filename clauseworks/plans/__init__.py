"""The queries that the package registers, and their SQL."""
