"""Spark building blocks."""
