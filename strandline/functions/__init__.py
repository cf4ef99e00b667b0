"""Column expressions over nucleotide sequences."""
