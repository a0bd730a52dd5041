"""Operators with state of their own: packing archives, rendering rasters, encoding images."""
