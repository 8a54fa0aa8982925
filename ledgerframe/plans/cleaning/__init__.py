"""Cleaning datasets B1-B17 over raw operational tables."""
