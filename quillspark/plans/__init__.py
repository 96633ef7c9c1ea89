"""Composed plans: chunk assembly, fixtures, queries and their SQL."""
