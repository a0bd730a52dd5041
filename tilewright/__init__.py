"""Spark-native raster-tile analytics: tile grids, archives, render plans."""
