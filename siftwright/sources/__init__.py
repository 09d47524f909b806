"""Readers that turn files and texts into rows."""
