"""Readers of subtitle files and adapters from the driver's tables."""
