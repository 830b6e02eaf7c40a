"""Quillon: streaming."""
