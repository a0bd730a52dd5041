"""Readers: tile directories, archives, georeferenced rasters."""
