"""Spark jobs for large sample x feature measurement matrices, DataFrame in and DataFrame out."""
