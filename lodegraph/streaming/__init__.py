"""Continuous rebuilds."""
