"""Reusable distributed building blocks: scratch space, global order, exact quantiles, statistics."""
