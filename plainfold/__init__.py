"""Reflow and diagnose prose held in Spark tables."""

__version__ = "0.2.0"
