"""Spatial tiling analytics and training-data operators as PySpark plans."""
