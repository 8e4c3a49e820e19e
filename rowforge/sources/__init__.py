"""Readers and profiles."""
