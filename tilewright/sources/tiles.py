"""XYZ tile directories: root/z/x/y.ext."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, text

NUMBER = r"^\+?[0-9]+$"


def number(name, most: int) -> Column:
    """The number a name stands for: digits, a plus sign and zeros before them allowed; null for anything else or beyond `most`."""
    c = grid._c(name)
    v = F.when(c.rlike(NUMBER), c).try_cast("decimal(38,0)")
    return F.when(v <= most, v).cast("long")


def parse_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds z, x, y, ext, format; all null where the path is not that of a tile."""
    d = files.withColumn("__parts", F.split(path, "/")).withColumn("__name", F.element_at("__parts", -1)).withColumn("ext", F.substring_index("__name", ".", -1))
    part = lambda i: F.try_element_at("__parts", F.lit(i))
    stem = F.when(F.contains("__name", F.lit(".")), F.expr("substring(__name, 1, length(__name) - length(ext) - 1)"))
    d = d.withColumns({"z": number(part(-3), 255).cast("int"), "x": number(part(-2), (1 << 32) - 1), "y": number(stem, (1 << 32) - 1), "ext": F.lower("ext")}).drop("__parts", "__name")
    d = d.withColumn("format", text.format_of_extension("ext"))
    tile = F.col("z").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("format").isNotNull()
    return d.withColumns({c: F.when(tile, F.col(c)) for c in ("z", "x", "y", "ext", "format")})


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """z, x, y, tile_id, path, byte_len, format (and content) of all tile files exactly three levels below root.

    What is not named like a tile is skipped; an address off its zoom's grid or a file of 4 GiB or more raises.
    File contents are not read unless asked for.
    """
    files = spark.read.format("binaryFile").load(root.rstrip("/") + "/*/*/*")
    d = parse_paths(files.select("path", F.col("length").alias("byte_len"), *(["content"] if content else []))).filter("z is not null")
    short = F.when(F.col("byte_len") < 1 << 32, F.col("byte_len")).otherwise(F.raise_error(F.concat(F.lit("tile file too long: "), F.col("path"))).cast("long"))
    return d.select("z", "x", "y", grid.tile_id_checked("z", "x", "y").alias("tile_id"), "path", short.alias("byte_len"), "format", *(["content"] if content else []))


def statistics(tiles: DataFrame) -> DataFrame:
    """One row: tiles, zooms, tile ranges, union of the tiles' bounds, formats. Partial sums first, one row a task shuffled."""
    b = tiles.withColumn("b", grid.lonlat_bounds("z", "x", "y"))
    return b.agg(
        F.count("*").alias("tiles"), F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"),
    )
