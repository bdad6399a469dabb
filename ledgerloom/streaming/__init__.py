"""Incremental bank feed."""
