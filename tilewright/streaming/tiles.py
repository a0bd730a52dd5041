"""Tile counts over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid


def tile_counts(points: DataFrame, z: int, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """points: ts, lon, lat. start, tile_id, points per window and tile; works on streams and tables alike. Rows later than `late` are left out of
    streams, and state is dropped after that."""
    t = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("ts", grid.tile_id(F.lit(z), grid.lon_to_x("lon", F.lit(z)), grid.lat_to_y("lat", F.lit(z))).alias("tile_id"))
    return t.groupBy(F.window("ts", window).alias("w"), "tile_id").agg(F.count("*").alias("points")).select(F.col("w.start").alias("start"), "tile_id", "points")
