"""Raster-over-time, curve, shape and graph analytics as PySpark DataFrame jobs."""
