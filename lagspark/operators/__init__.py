"""Operators on series, model and measure tables."""
