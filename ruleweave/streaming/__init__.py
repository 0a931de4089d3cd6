"""Incremental evaluation of streams."""
