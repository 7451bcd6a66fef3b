"""Geospatial catalogue, raster, vector and event analytics as plain Spark DataFrames."""
