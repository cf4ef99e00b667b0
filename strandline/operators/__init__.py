"""Operators on reads, k-mers, graphs and contigs."""
