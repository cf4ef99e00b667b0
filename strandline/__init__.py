"""Sequence analytics on Spark: reads, k-mers, assembly graphs and contigs as DataFrames."""
