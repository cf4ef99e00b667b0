"""Readers of sequence files and tables."""
