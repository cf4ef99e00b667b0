"""Whole assemblies: plans that run several operators in turn."""
