"""Tile jobs, chunk plans and archive layouts as DataFrames."""
