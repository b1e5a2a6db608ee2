"""Reusable DataFrame operators (joins, windows, quantiles, sampling, quality)."""
