"""Composed plans: dashboard pages and run details."""
