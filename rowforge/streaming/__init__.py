"""Continuous exports."""
