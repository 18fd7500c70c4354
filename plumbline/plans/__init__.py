"""Composed analyses, the registered queries and their reference SQL."""
