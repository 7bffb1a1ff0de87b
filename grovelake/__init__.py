"""Versioned analytics on Spark."""
