"""Archived-capture analytics on Spark."""
