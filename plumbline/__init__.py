"""Plumbline: distributed profiling, cleaning, time-series and modelling analyses for Spark DataFrames."""

__version__ = "0.1.0"
