"""Continuous analysis of folders."""
