import pytest
from pyspark.sql import functions as F

from tilewright.functions import grid, sql
from tilewright.plans import jobs

CONUS = (-126.0015, 24.9985, -59.9985, 50.0015)
WORLD = (-180.0, -85.05112878, 180.0, 85.05112878)


def test_tile_ids(spark):
    rows = [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (31, 2147483647, 0, 6148914691236517204), (11, 307, 700, 2301876)]
    d = spark.createDataFrame(rows, "z int, x long, y long, id long")
    assert d.filter(grid.tile_id("z", "x", "y") != F.col("id")).count() == 0
    sql.register(spark)
    d.createOrReplaceTempView("addresses")
    assert spark.sql("select * from addresses where tile_id(z, x, y) <> id").count() == 0
    assert spark.sql("select tile_x(0D, 1) x, tile_y(0D, 1) y, round(tile_north(1L, 1), 7) n").first() == (1, 1, 0.0)


def test_ids_are_dense(spark):
    j = jobs.tile_jobs(spark, WORLD, 0, 5)
    assert j.agg(F.min("tile_id"), F.max("tile_id"), F.count_distinct("tile_id")).first() == (0, 1364, 1365)


def test_tile_of_centre_is_tile(spark):
    j = jobs.tile_jobs(spark, CONUS, 0, 9).withColumn("b", grid.lonlat_bounds("z", "x", "y"))
    lon, lat = (F.col("b.west") + F.col("b.east")) / 2, (F.col("b.south") + F.col("b.north")) / 2
    assert j.filter((grid.lon_to_x(lon, "z") != F.col("x")) | (grid.lat_to_y(lat, "z") != F.col("y"))).count() == 0


def test_counts_per_zoom(spark):
    assert [r.tiles for r in jobs.zoom_ranges(CONUS, 0, 11)] == [1, 1, 2, 4, 8, 28, 91, 288, 1152, 4465, 17388, 69184]
    assert jobs.zoom_ranges((-125, 24, -66, 50), 3, 3)[0].tiles == 4
    assert jobs.tile_jobs(spark, WORLD, 0, 1).orderBy("tile_id").select("tile_id").collect() == [(i,) for i in range(5)]


def test_world_in_mercator(spark):
    b = spark.range(1).select(grid.mercator_bounds(F.lit(0), F.lit(0), F.lit(0)).alias("b")).select("b.*").first()
    assert all(abs(abs(v) - 20037508.342789244) < 1e-6 for v in b)


@pytest.mark.parametrize("z", [2, 5])
def test_auto_chunk(spark, z):
    assert jobs.chunk_plan(jobs.tile_jobs(spark, WORLD, z, z), workers=8).first().chunk == 4


def test_chunk_choices(spark):
    j = jobs.tile_jobs(spark, CONUS, 8, 8)
    assert jobs.chunk_plan(j, "auto").first().chunk == 8
    assert jobs.chunk_plan(j, "4").first().chunk == 4
    off = jobs.chunk_plan(j, "off").first()
    assert off.chunk is None and off.chunks == 1


@pytest.mark.parametrize("bounds", [(1, 0, 0, 1), (0, 1, 1, 0), (float("nan"), 0, 1, 1), (0, 86, 1, 89)])
def test_bad_bounds(bounds):
    with pytest.raises(ValueError):
        grid.normal_bounds(*bounds)


def test_bad_zooms():
    for lo, hi in ((3, 2), (0, 32), (-1, 2)):
        with pytest.raises(ValueError):
            jobs.zoom_ranges(WORLD, lo, hi)


def test_off_grid_raises(spark):
    with pytest.raises(Exception, match="off the grid"):
        spark.range(1).select(grid.tile_id_checked(F.lit(1), F.lit(2), F.lit(0))).collect()
