"""Stable-correctness analytics for systems that answer repeatedly over time, on Spark."""
