"""Readers for delivery folders, archives, layers, feeds and points."""
