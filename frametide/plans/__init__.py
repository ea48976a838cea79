"""Whole queries: operators composed, and bound to tables."""
