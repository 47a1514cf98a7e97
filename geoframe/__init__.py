"""Photogrammetric tables and the relational plans over them, on Spark DataFrames."""
