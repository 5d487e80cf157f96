"""Spark jobs for finding genomic deletions, built on DataFrames, Spark SQL and Spark ML."""
