"""Quillon: operators."""
