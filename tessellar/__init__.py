"""Tessellar."""
