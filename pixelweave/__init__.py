"""Raster and patch analytics on Spark DataFrames."""
