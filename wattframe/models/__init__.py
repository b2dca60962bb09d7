"""Fitting and scoring jobs."""
