"""Whole analysis runs and their reports."""
