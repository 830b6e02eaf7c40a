"""Quillon: sources."""
