"""Structural code analytics on Spark."""
