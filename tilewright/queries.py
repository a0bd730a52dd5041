"""Registered queries of the tile operators over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import codec, grid, sampling, text
from .operators import archive, render
from .plans import jobs, layout
from .sources import raster as rasters
from .sources import tiles as xyz
from .sources.archive import read_archive
from .storage import keep, shared_dir

CONUS = (-126.0015, 24.9985, -59.9985, 50.0015)
WORLD = (-180.0, -85.05112878, 180.0, 85.05112878)
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- points: the tables have no coordinates; ids give them


def points(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key).cast("long")
    return df.withColumns({"lon": (k * 7919 % 360000) / 1000.0 - 180.0, "lat": (k * 104729 % 170000) / 1000.0 - 85.0})


def sql_points(key: str) -> str:
    return f"(({key}::BIGINT * 7919) % 360000)::DOUBLE / 1000.0::DOUBLE - 180.0::DOUBLE AS lon, (({key}::BIGINT * 104729) % 170000)::DOUBLE / 1000.0::DOUBLE - 85.0::DOUBLE AS lat"


def sql_x(lon: str, z) -> str:
    return f"greatest(0, least((1::BIGINT << {z}) - 1, floor((least(greatest({lon}, -180.0::DOUBLE), 180.0::DOUBLE) + 180.0::DOUBLE) / 360.0::DOUBLE * (1::BIGINT << {z}))::BIGINT))"


def sql_y(lat: str, z) -> str:
    return f"greatest(0, least((1::BIGINT << {z}) - 1, floor((1.0::DOUBLE - asinh(tan(radians(least(greatest({lat}, -85.05112878::DOUBLE), 85.05112878::DOUBLE)))) / pi()) / 2.0::DOUBLE * (1::BIGINT << {z}))::BIGINT))"


def sql_ids(src: str) -> str:
    """CTE text defining ids(z, x, y, tile_id) for the distinct addresses of the query src (z, x, y)."""
    return f"""
a AS (SELECT DISTINCT z::INT AS z, x::BIGINT AS x, y::BIGINT AS y FROM ({src})),
h AS (
  SELECT z, x, y, x AS px, y AS py, z - 1 AS k, 0::BIGINT AS acc FROM a
  UNION ALL
  SELECT z, x, y,
    CASE WHEN (py >> k) & 1 = 1 THEN px & ((1::BIGINT << k) - 1) WHEN (px >> k) & 1 = 1 THEN (1::BIGINT << k) - 1 - (py & ((1::BIGINT << k) - 1)) ELSE py & ((1::BIGINT << k) - 1) END,
    CASE WHEN (py >> k) & 1 = 1 THEN py & ((1::BIGINT << k) - 1) WHEN (px >> k) & 1 = 1 THEN (1::BIGINT << k) - 1 - (px & ((1::BIGINT << k) - 1)) ELSE px & ((1::BIGINT << k) - 1) END,
    k - 1, acc + (xor(3 * ((px >> k) & 1), (py >> k) & 1) << (2 * k))
  FROM h WHERE k >= 0),
ids AS (SELECT z, x, y, ((1::BIGINT << (2 * z)) - 1) // 3 + acc AS tile_id FROM h WHERE k = -1)"""


def sql_jobs(bounds, lo: int, hi: int) -> str:
    w, s, e, n = (f"({v}::DOUBLE)" for v in bounds)
    return f"""SELECT z, x, y FROM (SELECT z, {sql_x(w, 'z')} AS x0, {sql_x(e, 'z')} AS x1, {sql_y(n, 'z')} AS y0, {sql_y(s, 'z')} AS y1 FROM generate_series({lo}, {hi}) g(z)) r,
  LATERAL (SELECT unnest(generate_series(x0, x1)) AS x) xs, LATERAL (SELECT unnest(generate_series(y0, y1)) AS y) ys"""


POINT_Z = 12


@query(f"SELECT event_id, {sql_x('lon', POINT_Z)}::BIGINT AS x, {sql_y('lat', POINT_Z)}::BIGINT AS y FROM (SELECT event_id, {sql_points('event_id')} FROM events)")
def q_point_to_tile(spark, sf_dir):
    z = F.lit(POINT_Z)
    return points(table(spark, sf_dir, "events"), "event_id").select("event_id", grid.lon_to_x("lon", z).alias("x"), grid.lat_to_y("lat", z).alias("y"))


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey, 14 AS z, {sql_x('lon', 14)} AS x, {sql_y('lat', 14)} AS y FROM (SELECT c_custkey, {sql_points('c_custkey')} FROM customer)), {sql_ids('SELECT z, x, y FROM p')}
SELECT c_custkey, tile_id FROM p JOIN ids USING (x, y)""")
def q_tile_id(spark, sf_dir):
    z = F.lit(14)
    return points(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", grid.tile_id(z, grid.lon_to_x("lon", z), grid.lat_to_y("lat", z)).alias("tile_id"))


@query(f"""WITH RECURSIVE p AS (SELECT 10 AS z, {sql_x('lon', 10)} AS x, {sql_y('lat', 10)} AS y, value FROM (SELECT value, {sql_points('event_id')} FROM events)), {sql_ids('SELECT z, x, y FROM p')}
SELECT tile_id, x::BIGINT AS x, y::BIGINT AS y, count(*) AS events, round(sum(value), 4) AS total FROM p JOIN ids USING (x, y) GROUP BY ALL""")
def q_tile_agg(spark, sf_dir):
    z = F.lit(10)
    p = points(table(spark, sf_dir, "events"), "event_id").select(grid.lon_to_x("lon", z).alias("x"), grid.lat_to_y("lat", z).alias("y"), "value")
    g = p.groupBy("x", "y").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(grid.tile_id(z, "x", "y").alias("tile_id"), "x", "y", "events", "total").orderBy("tile_id")


def nation_tiles(spark, sf_dir):
    p = points(table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long") + 1), "k")
    return p.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("z"), "lon", "lat").select("n_nationkey", "z", grid.lon_to_x("lon", "z").alias("x"), grid.lat_to_y("lat", "z").alias("y"))


SQL_NATION_TILES = f"SELECT n_nationkey, z::INT AS z, {sql_x('lon', 'z')} AS x, {sql_y('lat', 'z')} AS y FROM (SELECT n_nationkey, {sql_points('(n_nationkey + 1)')} FROM nation), generate_series(0, 18) g(z)"


@query(f"""SELECT n_nationkey, z, round(-20037508.342789244::DOUBLE + x * side, 3) + 0.0::DOUBLE AS min_x, round(20037508.342789244::DOUBLE - y * side - side, 3) + 0.0::DOUBLE AS min_y,
  round(-20037508.342789244::DOUBLE + x * side + side, 3) + 0.0::DOUBLE AS max_x, round(20037508.342789244::DOUBLE - y * side, 3) + 0.0::DOUBLE AS max_y FROM (SELECT *, 40075016.685578488::DOUBLE / (1::BIGINT << z) AS side FROM ({SQL_NATION_TILES}))""")
def q_tile_bounds_merc(spark, sf_dir):
    b = nation_tiles(spark, sf_dir).withColumn("b", grid.mercator_bounds("z", "x", "y"))
    return b.select("n_nationkey", "z", *((F.round(f"b.{c}", 3) + 0.0).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query(f"""WITH t AS (SELECT n_nationkey, z, x::DOUBLE AS x, y::DOUBLE AS y, (1::BIGINT << z)::DOUBLE AS n FROM ({SQL_NATION_TILES})),
u AS (SELECT *, pi() - 2.0::DOUBLE * pi() * y / n AS a, pi() - 2.0::DOUBLE * pi() * (y + 1) / n AS b FROM t)
SELECT n_nationkey, z, round(x / n * 360.0::DOUBLE - 180.0::DOUBLE, 7) AS west, round((x + 1) / n * 360.0::DOUBLE - 180.0::DOUBLE, 7) AS east,
  round(degrees(atan((exp(b) - exp(-b)) / 2)), 7) AS south, round(degrees(atan((exp(a) - exp(-a)) / 2)), 7) AS north FROM u""")
def q_tile_bounds_lonlat(spark, sf_dir):
    b = nation_tiles(spark, sf_dir).withColumn("b", grid.lonlat_bounds("z", "x", "y"))
    return b.select("n_nationkey", "z", *(F.round(f"b.{c}", 7).alias(c) for c in ("west", "east", "south", "north")))


@query("""SELECT s_suppkey, round(mx / 20037508.342789244::DOUBLE * 180.0::DOUBLE, 7) AS lon, round(degrees(2.0::DOUBLE * atan(exp(my / 20037508.342789244::DOUBLE * pi())) - pi() / 2.0::DOUBLE), 7) AS lat
FROM (SELECT s_suppkey, ((s_suppkey * 7919) % 40000 - 20000)::DOUBLE * 1000.0::DOUBLE AS mx, ((s_suppkey * 104729) % 40000 - 20000)::DOUBLE * 1000.0::DOUBLE AS my FROM supplier)""")
def q_merc_to_lonlat(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7919 % 40000 - 20000) * 1000.0).alias("mx"), ((F.col("s_suppkey") * 104729 % 40000 - 20000) * 1000.0).alias("my"))
    return s.select("s_suppkey", F.round(grid.mercator_to_lon("mx"), 7).alias("lon"), F.round(grid.mercator_to_lat("my"), 7).alias("lat"))


@query(f"""WITH RECURSIVE j AS ({sql_jobs(CONUS, 0, 8)}), {sql_ids('SELECT z, x, y FROM j')} SELECT z, x, y, tile_id FROM ids""")
def q_enumerate_jobs(spark, sf_dir):
    return jobs.tile_jobs(spark, CONUS, 0, 8)


@query(f"SELECT z::INT AS z, count(*) AS tiles FROM ({sql_jobs(CONUS, 0, 11)}) GROUP BY z")
def q_tiles_by_zoom(spark, sf_dir):
    return jobs.tiles_by_zoom(jobs.tile_jobs(spark, CONUS, 0, 11))


@query(f"""WITH RECURSIVE j AS ({sql_jobs(CONUS, 5, 7)}), {sql_ids('SELECT z, x, y FROM j')} SELECT tile_id, z, x, y FROM ids ORDER BY tile_id LIMIT 1""")
def q_first_tile(spark, sf_dir):
    return jobs.tile_jobs(spark, CONUS, 5, 7).orderBy("tile_id").limit(1).select("tile_id", "z", "x", "y")


@query(f"SELECT z::INT AS z, (x // 4)::BIGINT AS cx, (y // 4)::BIGINT AS cy, count(*) AS tiles, max(x % 4)::BIGINT AS last_x, max(y % 4)::BIGINT AS last_y FROM ({sql_jobs(CONUS, 0, 9)}) GROUP BY ALL")
def q_chunk_assign(spark, sf_dir):
    j = jobs.with_chunks(jobs.tile_jobs(spark, CONUS, 0, 9), 4)
    return j.groupBy("z", "cx", "cy").agg(F.count("*").alias("tiles"), F.max("in_x").alias("last_x"), F.max("in_y").alias("last_y"))


SQL_EXTENTS = f"SELECT z::INT AS z, count(*) AS tiles, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ({sql_jobs(CONUS, 0, 11)}) GROUP BY z"


@query(f"""WITH j AS ({sql_jobs(CONUS, 0, 11)}) SELECT z::INT AS z, (max(x % 8) + 1)::BIGINT AS widest, (max(y % 8) + 1)::BIGINT AS highest, ((max(x % 8) + 1) * 512 * (max(y % 8) + 1) * 512 * 8)::DOUBLE / 1048576 AS mib FROM j GROUP BY z""")
def q_widest_chunk(spark, sf_dir):
    j = jobs.with_chunks(jobs.tile_jobs(spark, CONUS, 0, 11), 8).groupBy("z").agg((F.max("in_x") + 1).alias("widest"), (F.max("in_y") + 1).alias("highest"))
    return j.withColumn("mib", jobs.chunk_bytes("widest", "highest", F.lit(512).cast("long")) / jobs.MIB)


@query(f"""WITH e AS ({SQL_EXTENTS}), c AS (SELECT *, CASE WHEN ((w + 3) // 4) * ((h + 3) // 4) > least(greatest(least(8, tiles) * 8, 1), tiles) AND greatest(w, h) > 4 THEN 8 ELSE 4 END AS chunk FROM e)
SELECT z, tiles, chunk::BIGINT AS chunk, (((w + chunk - 1) // chunk) * ((h + chunk - 1) // chunk))::BIGINT AS chunks FROM c""")
def q_auto_chunk(spark, sf_dir):
    return jobs.chunk_plan(jobs.tile_jobs(spark, CONUS, 0, 11), "auto", workers=8).select("z", "tiles", "chunk", "chunks")


@query(f"""WITH t AS (SELECT DISTINCT z, {sql_x('lon', 'z')} AS x, {sql_y('lat', 'z')} AS y FROM (SELECT {sql_points('event_id')} FROM events), generate_series(3, 8) g(z)),
u AS (SELECT *, (1::BIGINT << z)::DOUBLE AS n, pi() - 2.0::DOUBLE * pi() * y / (1::BIGINT << z)::DOUBLE AS a, pi() - 2.0::DOUBLE * pi() * (y + 1) / (1::BIGINT << z)::DOUBLE AS b FROM t)
SELECT count(*) AS tiles, min(z)::INT AS min_zoom, max(z)::INT AS max_zoom, min(x)::BIGINT AS min_x, max(x)::BIGINT AS max_x, min(y)::BIGINT AS min_y, max(y)::BIGINT AS max_y,
  round(min(x / n * 360.0::DOUBLE - 180.0::DOUBLE), 7) AS west, round(min(degrees(atan((exp(b) - exp(-b)) / 2))), 7) AS south, round(max((x + 1) / n * 360.0::DOUBLE - 180.0::DOUBLE), 7) AS east, round(max(degrees(atan((exp(a) - exp(-a)) / 2))), 7) AS north FROM u""")
def q_tile_stats(spark, sf_dir):
    p = points(table(spark, sf_dir, "events"), "event_id").select(F.explode(F.sequence(F.lit(3), F.lit(8))).alias("z"), "lon", "lat")
    s = xyz.statistics(p.select("z", grid.lon_to_x("lon", "z").alias("x"), grid.lat_to_y("lat", "z").alias("y")).distinct())
    return s.withColumns({c: F.round(c, 7) for c in ("west", "south", "east", "north")})


@query(f"""SELECT event_id, round(lon * 1e7::DOUBLE)::INT AS lon_e7, round(lat * 1e7::DOUBLE)::INT AS lat_e7, round(round(lon * 1e7::DOUBLE)::INT / 1e7::DOUBLE, 7) AS lon, round(round(lat * 1e7::DOUBLE)::INT / 1e7::DOUBLE, 7) AS lat FROM (SELECT event_id, {sql_points('event_id')} FROM events)""")
def q_e7_roundtrip(spark, sf_dir):
    p = points(table(spark, sf_dir, "events"), "event_id").select("event_id", grid.to_e7("lon").alias("lon_e7"), grid.to_e7("lat").alias("lat_e7"))
    return p.select("event_id", "lon_e7", "lat_e7", F.round(grid.from_e7("lon_e7"), 7).alias("lon"), F.round(grid.from_e7("lat_e7"), 7).alias("lat"))


# --- archive layout


def doc_tiles(spark, sf_dir):
    """A tile for each document: zoom 24, address from the id, payload the text."""
    d = table(spark, sf_dir, "documents")
    return d.select(grid.tile_id(F.lit(24), F.col("doc_id") % 4096, F.call_function("div", F.col("doc_id"), F.lit(4096).cast("long"))).alias("tile_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"))


SQL_DOC_TILES = f"""d AS (SELECT 24 AS z, doc_id % 4096 AS x, doc_id // 4096 AS y, coalesce(octet_length(encode(text)), 0)::BIGINT AS length FROM documents), {sql_ids('SELECT z, x, y FROM d')},
e AS (SELECT tile_id, length, row_number() OVER o - 1 AS row, coalesce(sum(length) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d JOIN ids USING (x, y) WINDOW o AS (ORDER BY tile_id))"""


@query(f'WITH RECURSIVE {SQL_DOC_TILES} SELECT tile_id, length, row, "offset" FROM e')
def q_entries_offsets(spark, sf_dir):
    return layout.with_offsets(doc_tiles(spark, sf_dir))


def sql_directory(leaf: int) -> str:
    return f"""c AS (SELECT *, row // {leaf} AS leaf FROM e),
k AS (SELECT *, tile_id - coalesce(lag(tile_id) OVER w, 0) AS delta, 1 AS run_length, CASE WHEN lag("offset") OVER w + lag(length) OVER w = "offset" THEN 0 ELSE "offset" + 1 END AS offset_code FROM c WINDOW w AS (PARTITION BY leaf ORDER BY tile_id))"""


@query(f"WITH RECURSIVE {SQL_DOC_TILES}, {sql_directory(256)} SELECT leaf::BIGINT AS leaf, tile_id, delta::BIGINT AS delta, run_length, length, offset_code::BIGINT AS offset_code FROM k")
def q_directory_columns(spark, sf_dir):
    return layout.directory_columns(layout.with_offsets(doc_tiles(spark, sf_dir)), 256).select("leaf", "tile_id", "delta", "run_length", "length", "offset_code")


def line_tiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tile_id"), (F.col("l_quantity") * 100 + F.col("l_linenumber")).cast("long").alias("length")).groupBy("tile_id").agg(F.sum("length").alias("length"))


SQL_LINE_TILES = """t AS (SELECT l_orderkey * 8 + l_linenumber AS tile_id, sum((l_quantity * 100 + l_linenumber)::BIGINT)::BIGINT AS length FROM lineitem GROUP BY 1),
e AS (SELECT *, row_number() OVER o - 1 AS row, coalesce(sum(length) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM t WINDOW o AS (ORDER BY tile_id))"""


def sql_varint(v: str) -> str:
    return f"greatest(1, ceil(length(bin(({v})::BIGINT)) / 7.0))::BIGINT"


SQL_LEAVES = f"""{SQL_LINE_TILES}, {sql_directory(codec.LEAF_ENTRIES)},
s AS (SELECT leaf, min(tile_id) AS first_id, count(*) AS entries, sum({sql_varint('delta')} + {sql_varint('run_length')} + {sql_varint('length')} + {sql_varint('offset_code')}) + {sql_varint('count(*)')} AS bytes FROM k GROUP BY leaf)"""


def line_leaves(spark, sf_dir):
    return layout.leaf_sizes(layout.directory_columns(layout.with_offsets(line_tiles(spark, sf_dir)), codec.LEAF_ENTRIES))


@query(f"""WITH {SQL_LEAVES} SELECT leaf::BIGINT AS leaf, first_id::BIGINT AS tile_id, coalesce(sum(bytes) OVER (ORDER BY leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", bytes::BIGINT AS length, 0 AS run_length FROM s""")
def q_leaf_pointers(spark, sf_dir):
    return layout.leaf_pointers(line_leaves(spark, sf_dir))


@query(f"WITH {SQL_LEAVES} SELECT leaf::BIGINT AS leaf, first_id::BIGINT AS first_id, entries, bytes::BIGINT AS bytes FROM s")
def q_directory_bytes(spark, sf_dir):
    return line_leaves(spark, sf_dir)


@query(f"""WITH {SQL_LEAVES} SELECT sum(entries)::BIGINT AS entries, sum(bytes)::BIGINT AS leaf_bytes, count(*) AS leaves, 4 * sum(entries) > {codec.ROOT_LIMIT} AS needs_leaves FROM s""")
def q_flat_or_leaves(spark, sf_dir):
    return line_leaves(spark, sf_dir).agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("leaf_bytes"), F.count("*").alias("leaves"), (4 * F.sum("entries") > codec.ROOT_LIMIT).alias("needs_leaves"))


@query("""WITH g AS (SELECT l_suppkey, count(*) * 500 AS entries, sum(l_quantity)::BIGINT * 40 AS data FROM lineitem GROUP BY l_suppkey), r AS (SELECT *, least(greatest(24 * entries, 65536), 16777216) AS reserve FROM g), p AS (SELECT *, reserve - 6 * entries AS gap FROM r)
SELECT l_suppkey, entries::BIGINT AS entries, data::BIGINT AS data, reserve::BIGINT AS reserve, gap::BIGINT AS gap, gap > 0 AND data <= 4 * gap AS compact FROM p""")
def q_reserve_compact(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.count("*") * 500).alias("entries"), (F.sum("l_quantity").cast("long") * 40).alias("data"))
    g = g.withColumn("reserve", codec.reserve_bytes("entries")).withColumn("gap", F.col("reserve") - 6 * F.col("entries"))
    return g.withColumn("compact", codec.compacted("data", "gap"))


# --- tile directories


def paths(spark, sf_dir):
    """A path per line: most are tiles, some have other names, addresses off the grid, or other extensions."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    z = F.when(k % 23 == 0, "a").when(k % 19 == 0, "+3").when(k % 31 == 0, "99").otherwise((k % 7).cast("string"))
    x = F.when(k % 29 == 0, " 1").otherwise((k % 40).cast("string"))
    y = F.when(k % 37 == 0, "007").otherwise((k % 33).cast("string"))
    ext = F.element_at(F.array(*map(F.lit, ("png", "JPG", "jpeg", "webp", "avif", "txt"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(k.alias("k"), F.concat(F.lit("root/"), z, F.lit("/"), x, F.lit("/"), y, F.lit("."), ext).alias("path"))


SQL_PATHS = """p AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'a' WHEN k % 19 = 0 THEN '+3' WHEN k % 31 = 0 THEN '99' ELSE (k % 7)::VARCHAR END AS zs, CASE WHEN k % 29 = 0 THEN ' 1' ELSE (k % 40)::VARCHAR END AS xs,
  CASE WHEN k % 37 = 0 THEN '007' ELSE (k % 33)::VARCHAR END AS ys, (['png', 'jpg', 'jpeg', 'webp', 'avif', 'txt'])[k % 6 + 1] AS ext FROM (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem)),
q AS (SELECT *, regexp_full_match(zs, '\\+?[0-9]+') AND regexp_full_match(xs, '\\+?[0-9]+') AND ext <> 'txt' AS tile FROM p),
r AS (SELECT k, tile, CASE WHEN tile THEN replace(zs, '+', '')::INT END AS z, CASE WHEN tile THEN trim(xs)::BIGINT END AS x, CASE WHEN tile THEN ys::BIGINT END AS y, CASE WHEN tile THEN ext END AS ext,
  CASE WHEN tile THEN CASE ext WHEN 'jpeg' THEN 'jpg' ELSE ext END END AS format FROM q)"""


@query(f"WITH {SQL_PATHS} SELECT k, z, x, y, ext, format FROM r")
def q_path_parse(spark, sf_dir):
    return xyz.parse_paths(paths(spark, sf_dir)).select("k", "z", "x", "y", "ext", "format")


@query(f"WITH {SQL_PATHS} SELECT CASE WHEN NOT tile THEN 'skipped' WHEN z > 31 OR x >= (1::BIGINT << least(z, 31)) OR y >= (1::BIGINT << least(z, 31)) THEN 'off grid' ELSE 'tile' END AS outcome, count(*) AS files FROM r GROUP BY 1")
def q_path_reject(spark, sf_dir):
    p = xyz.parse_paths(paths(spark, sf_dir))
    return p.groupBy(F.when(F.col("z").isNull(), "skipped").when(grid.on_grid("z", "x", "y"), "tile").otherwise("off grid").alias("outcome")).agg(F.count("*").alias("files"))


@query(f"WITH {SQL_PATHS} SELECT z, count(DISTINCT format) AS formats, min(format) AS first_format, count(DISTINCT format) = 1 AS uniform FROM r WHERE tile GROUP BY z")
def q_format_check(spark, sf_dir):
    p = xyz.parse_paths(paths(spark, sf_dir)).filter("z is not null")
    g = p.groupBy("z").agg(F.count_distinct("format").alias("formats"), F.min("format").alias("first_format"))
    return g.withColumn("uniform", F.col("formats") == 1)


@query(f"""WITH b AS (SELECT event_id, lon * 1.2::DOUBLE AS w, lat * 1.2::DOUBLE AS s, lon * 1.2::DOUBLE + (event_id % 90 - 10)::DOUBLE AS e, lat * 1.2::DOUBLE + (event_id % 50 - 5)::DOUBLE AS n FROM (SELECT event_id, {sql_points('event_id')} FROM events))
SELECT event_id, CASE WHEN NOT (w < e AND s < n) THEN 'empty' WHEN NOT (greatest(w, -180) < least(e, 180) AND greatest(s, -85.05112878::DOUBLE) < least(n, 85.05112878::DOUBLE)) THEN 'outside' ELSE 'ok' END AS state,
  round(greatest(w, -180::DOUBLE), 7) AS west, round(greatest(s, -85.05112878::DOUBLE), 7) AS south, round(least(e, 180::DOUBLE), 7) AS east, round(least(n, 85.05112878::DOUBLE), 7) AS north FROM b""")
def q_bounds_normalize(spark, sf_dir):
    p = points(table(spark, sf_dir, "events"), "event_id")
    b = p.select("event_id", (F.col("lon") * 1.2).alias("w"), (F.col("lat") * 1.2).alias("s"), (F.col("lon") * 1.2 + (F.col("event_id") % 90 - 10).cast("double")).alias("e"), (F.col("lat") * 1.2 + (F.col("event_id") % 50 - 5).cast("double")).alias("n"))
    clamped = {"west": F.greatest("w", F.lit(-180.0)), "south": F.greatest("s", F.lit(-grid.MAX_LAT)), "east": F.least("e", F.lit(180.0)), "north": F.least("n", F.lit(grid.MAX_LAT))}
    return b.select("event_id", grid.bounds_state("w", "s", "e", "n").alias("state"), *(F.round(v, 7).alias(k) for k, v in clamped.items()))


@query(f"""WITH r AS (SELECT s_suppkey, lon, lat, lon + (s_suppkey % 20 + 1) AS lon2, lat + (s_suppkey % 10 + 1) AS lat2 FROM (SELECT s_suppkey, {sql_points('s_suppkey')} FROM supplier)), c AS (SELECT DISTINCT x // 4 AS cx, y // 4 AS cy FROM ({sql_jobs(CONUS, 6, 6)})),
b AS (SELECT s_suppkey, {sql_x('lon', 6)} // 4 AS cx0, {sql_x('lon2', 6)} // 4 AS cx1, {sql_y('lat2', 6)} // 4 AS cy0, {sql_y('lat', 6)} // 4 AS cy1 FROM r)
SELECT s_suppkey, cx::BIGINT AS cx, cy::BIGINT AS cy FROM b JOIN c ON cx BETWEEN cx0 AND cx1 AND cy BETWEEN cy0 AND cy1""")
def q_chunk_source_overlap(spark, sf_dir):
    """Rectangles against chunks. A rectangle knows which chunks it touches, so the range join is an equi join on chunks."""
    z = F.lit(6)
    p = points(table(spark, sf_dir, "supplier"), "s_suppkey").withColumns({"lon2": F.col("lon") + (F.col("s_suppkey") % 20 + 1), "lat2": F.col("lat") + (F.col("s_suppkey") % 10 + 1)})
    four = F.lit(4).cast("long")
    div = lambda v: F.call_function("div", v, four)
    c = p.select("s_suppkey", F.explode(F.sequence(div(grid.lon_to_x("lon", z)), div(grid.lon_to_x("lon2", z)))).alias("cx"), grid.lat_to_y("lat2", z).alias("y0"), grid.lat_to_y("lat", z).alias("y1"))
    c = c.select("s_suppkey", "cx", F.explode(F.sequence(div(F.col("y0")), div(F.col("y1")))).alias("cy"))
    return c.join(jobs.with_chunks(jobs.tile_jobs(spark, CONUS, 6, 6), 4).select("cx", "cy").distinct(), ["cx", "cy"]).select("s_suppkey", "cx", "cy")


SQL_MERGE = f"""WITH RECURSIVE j AS ({sql_jobs(CONUS, 6, 7)}), t AS (SELECT DISTINCT z, {sql_x('lon', 'z')} AS x, {sql_y('lat', 'z')} AS y FROM (SELECT {sql_points('event_id')} FROM events), generate_series(6, 7) g(z)),
m AS (SELECT z, x, y, max(j) AS j, max(t) AS t FROM (SELECT z, x, y, 1 AS j, 0 AS t FROM j UNION ALL SELECT z, x, y, 0, 1 FROM t) GROUP BY ALL), {sql_ids('SELECT z, x, y FROM m')}"""


def event_tiles(spark, sf_dir):
    p = points(table(spark, sf_dir, "events"), "event_id").select(F.explode(F.sequence(F.lit(6), F.lit(7))).alias("z"), "lon", "lat")
    return p.select(grid.tile_id("z", grid.lon_to_x("lon", "z"), grid.lat_to_y("lat", "z")).alias("tile_id")).distinct()


@query(f"{SQL_MERGE} SELECT tile_id, CASE WHEN t = 0 THEN 'missing' ELSE 'unexpected' END AS side FROM m JOIN ids USING (z, x, y) WHERE j + t = 1")
def q_missing_tiles(spark, sf_dir):
    return render.missing(jobs.tile_jobs(spark, CONUS, 6, 7), event_tiles(spark, sf_dir))


@query(f"{SQL_MERGE} SELECT tile_id, z, x, y FROM m JOIN ids USING (z, x, y) WHERE j = 1 AND t = 1")
def q_ordered_merge(spark, sf_dir):
    return jobs.tile_jobs(spark, CONUS, 6, 7).join(event_tiles(spark, sf_dir), "tile_id").orderBy("tile_id").select("tile_id", "z", "x", "y")


# --- resampling arithmetic


SQL_TAPS = f"""p AS (SELECT event_id, (lon - -170.0::DOUBLE) / 0.25::DOUBLE - 0.5::DOUBLE AS pos FROM (SELECT event_id, {sql_points('event_id')} FROM events)), t AS (SELECT *, least(greatest(floor(pos)::BIGINT, 0), 1279) AS lower FROM p)"""


@query(f"WITH {SQL_TAPS} SELECT event_id, lower::BIGINT AS lower, least(lower + 1, 1279)::BIGINT AS upper, round(least(greatest(pos - lower, 0.0::DOUBLE), 1.0::DOUBLE), 7) AS weight, least(greatest(round(pos)::BIGINT, 0), 1279)::BIGINT AS nearest FROM t")
def q_sample_taps(spark, sf_dir):
    p = points(table(spark, sf_dir, "events"), "event_id").select("event_id", sampling.source_position("lon", -170.0, 0.25).alias("pos"))
    t = p.select("event_id", sampling.tap("pos", F.lit(1280)).alias("t"), sampling.tap("pos", F.lit(1280), nearest=True).alias("n"))
    return t.select("event_id", "t.lower", "t.upper", F.round("t.weight", 7).alias("weight"), F.col("n.lower").alias("nearest"))


@query(f"WITH {SQL_TAPS} SELECT (event_id % 64)::BIGINT AS chunk, min(lower)::BIGINT AS first_col, (max(least(lower + 1, 1279)) + 1)::BIGINT AS end_col FROM t GROUP BY 1")
def q_tap_window(spark, sf_dir):
    p = points(table(spark, sf_dir, "events"), "event_id").select((F.col("event_id") % 64).alias("chunk"), sampling.tap(sampling.source_position("lon", -170.0, 0.25), F.lit(1280)).alias("t"))
    return p.groupBy("chunk").agg(F.min("t.lower").alias("first_col"), (F.max("t.upper") + 1).alias("end_col"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS g, (vec_id % 57)::DOUBLE / 8 AS px, (vec_id % 53)::DOUBLE / 8 AS py FROM embeddings),
t AS (SELECT *, least(greatest(floor(px)::BIGINT, 0), 7) AS x0, least(greatest(floor(py)::BIGINT, 0), 7) AS y0 FROM p),
u AS (SELECT *, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1, px - x0 AS wx, py - y0 AS wy FROM t)
SELECT vec_id, round((g[y0 * 8 + x0 + 1] * (1 - wx) + g[y0 * 8 + x1 + 1] * wx) * (1 - wy) + (g[y1 * 8 + x0 + 1] * (1 - wx) + g[y1 * 8 + x1 + 1] * wx) * wy, 6) AS value FROM u""")
def q_bilinear_grid(spark, sf_dir):
    """Each vector as a grid of 8 x 8 pixels, sampled at a point."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("g"), sampling.tap((F.col("vec_id") % 57) / 8.0, F.lit(8)).alias("x"), sampling.tap((F.col("vec_id") % 53) / 8.0, F.lit(8)).alias("y"))
    at = lambda x, y: F.get("g", (F.col(f"y.{y}") * 8 + F.col(f"x.{x}")).cast("int"))
    return e.select("vec_id", F.round(sampling.blend(at("lower", "lower"), at("upper", "lower"), at("lower", "upper"), at("upper", "upper"), F.col("x.weight"), F.col("y.weight")), 6).alias("value"))


@query("""WITH r AS (SELECT r_regionkey, (-1.0e7 + r_regionkey * 1.0e6)::DOUBLE AS x0, 5.0e6::DOUBLE AS y0 FROM region), s AS (SELECT i::DOUBLE / 21.0::DOUBLE AS t FROM generate_series(0, 21) g(i)),
p AS (SELECT r_regionkey, x0, y0, t * 400.0::DOUBLE AS px, 0.0::DOUBLE AS py FROM r, s UNION ALL SELECT r_regionkey, x0, y0, t * 400.0::DOUBLE, 300.0::DOUBLE FROM r, s UNION ALL SELECT r_regionkey, x0, y0, 0.0::DOUBLE, t * 300.0::DOUBLE FROM r, s UNION ALL SELECT r_regionkey, x0, y0, 400.0::DOUBLE, t * 300.0::DOUBLE FROM r, s),
m AS (SELECT r_regionkey, (x0 + px * 10000.0::DOUBLE) / 20037508.342789244::DOUBLE * 180.0::DOUBLE AS lon, degrees(2.0::DOUBLE * atan(exp((y0 - py * 10000.0::DOUBLE) / 20037508.342789244::DOUBLE * pi())) - pi() / 2.0::DOUBLE) AS lat FROM p)
SELECT r_regionkey, round(min(lon), 7) AS west, round(min(lat), 7) AS south, round(max(lon), 7) AS east, round(max(lat), 7) AS north FROM m GROUP BY 1""")
def q_bounds_infer(spark, sf_dir):
    """Bounds of rasters in EPSG:3857 from points along their edges."""
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: i / 21.0)).alias("t")
    r = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.col("r_regionkey") * 1.0e6 - 1.0e7, F.lit(10000.0), F.lit(0.0), F.lit(5.0e6), F.lit(0.0), F.lit(-10000.0)).alias("gt"), t)
    pt = lambda x, y: sampling.affine("gt", x, y)
    w, h, zero = F.lit(400.0), F.lit(300.0), F.lit(0.0)
    p = r.select("r_regionkey", F.explode(F.array(pt(F.col("t") * w, zero), pt(F.col("t") * w, h), pt(zero, F.col("t") * h), pt(w, F.col("t") * h))).alias("p"))
    p = p.select("r_regionkey", grid.mercator_to_lon("p.x").alias("lon"), grid.mercator_to_lat("p.y").alias("lat")).filter("not isnan(lon) and not isnan(lat)")
    return p.groupBy("r_regionkey").agg(F.round(F.min("lon"), 7).alias("west"), F.round(F.min("lat"), 7).alias("south"), F.round(F.max("lon"), 7).alias("east"), F.round(F.max("lat"), 7).alias("north"))


@query("""SELECT epsg, north_up, kernel, asked, n_nationkey, CASE WHEN kernel IN ('nearest', 'bilinear') AND north_up AND epsg = 3857 AND asked IN ('auto', 'same-crs') THEN 'same-crs' WHEN kernel IN ('nearest', 'bilinear') AND north_up AND epsg = 4326 AND asked IN ('auto', 'geographic') THEN 'geographic' ELSE 'warp' END AS strategy
FROM (SELECT n_nationkey, ([3857, 4326, 32633])[n_nationkey % 3 + 1] AS epsg, n_nationkey % 5 <> 0 AS north_up FROM nation), (VALUES ('nearest'), ('bilinear'), ('cubic')) k(kernel), (VALUES ('auto'), ('same-crs'), ('geographic'), ('warp')) a(asked)""")
def q_strategy_select(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(F.lit(3857), F.lit(4326), F.lit(32633)), F.col("n_nationkey") % 3 + 1).alias("epsg"), (F.col("n_nationkey") % 5 != 0).alias("north_up"))
    n = n.select("*", F.explode(F.array(*map(F.lit, ("nearest", "bilinear", "cubic")))).alias("kernel")).select("*", F.explode(F.array(*map(F.lit, ("auto", "same-crs", "geographic", "warp")))).alias("asked"))
    return n.withColumn("strategy", sampling.strategy("epsg", "north_up", F.lit(True), "kernel", "asked"))


# --- texts


def sql_escape(s: str) -> str:
    out = f"replace({s}, chr(92), chr(92) || chr(92))"
    out = f"replace({out}, '\"', chr(92) || '\"')"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        out = f"replace({out}, chr({code}), chr(92) || '{letter}')"
    return out


@query(f"SELECT doc_id, {sql_escape('text')} AS escaped FROM documents")
def q_json_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.json_escape("text").alias("escaped"))


@query(f"""SELECT doc_id, '{{"name":"' || {sql_escape('source')} || '","description":"' || {sql_escape('coalesce(lang, source)')} || '","attribution":"","type":"overlay","version":"1.0.0","format":"png","tileSize":512,"minzoom":2,"maxzoom":' || (doc_id % 10 + 2) ||
  printf(',"bounds":[%.7f,%.7f,%.7f,%.7f],"center":[%.7f,%.7f,2]}}', lon, lat, lon + 1, lat + 1, (lon + lon + 1) / 2, (lat + lat + 1) / 2) AS metadata FROM (SELECT *, {sql_points('doc_id')} FROM documents)""")
def q_metadata_json(spark, sf_dir):
    d = points(table(spark, sf_dir, "documents"), "doc_id")
    m = text.metadata_json("source", "lang", F.lit(None).cast("string"), F.lit("png"), F.lit(512), F.lit(2), F.col("doc_id") % 10 + 2, F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1)
    return d.select("doc_id", m.alias("metadata"))


def order_sizes(spark, sf_dir):
    """n in 38 digits: from key 2 147 482 on, squares leave a long; these digits hold them to 7e15."""
    k = F.col("o_orderkey")
    wide = k.cast(text.WHOLE)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.when(k % 3 == 0, wide * 7919 + 13).when(k % 3 == 1, wide * wide * 1000003 + 7).otherwise(k % 2000) * 2 + 1).alias("n"))


SQL_ORDER_SIZES = "s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 7919 + 13 WHEN o_orderkey % 3 = 1 THEN o_orderkey * o_orderkey * 1000003 + 7 ELSE o_orderkey % 2000 END * 2 + 1 AS n FROM orders)"


@query(f"""WITH {SQL_ORDER_SIZES} SELECT o_orderkey, CASE WHEN n >= 1::BIGINT << 40 THEN printf('%.1f TiB', n / (1::BIGINT << 40)::DOUBLE) WHEN n >= 1 << 30 THEN printf('%.1f GiB', n / (1 << 30)::DOUBLE) WHEN n >= 1 << 20 THEN printf('%.1f MiB', n / (1 << 20)::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024::DOUBLE) ELSE n || ' B' END AS size FROM s""")
def q_format_bytes(spark, sf_dir):
    return order_sizes(spark, sf_dir).select("o_orderkey", text.bytes_text("n").alias("size"))


@query(f"WITH {SQL_ORDER_SIZES} SELECT o_orderkey, format('{{:,}}', n) AS count, CASE WHEN n = 1 THEN '1 tile' ELSE format('{{:,}}', n) || ' tiles' END AS tiles, n || ' @ ' || o_orderkey AS section, CASE WHEN n % 3 = 0 THEN 'yes' ELSE 'no' END AS flag FROM s")
def q_format_count(spark, sf_dir):
    s = order_sizes(spark, sf_dir)
    return s.select("o_orderkey", text.count_text("n").alias("count"), text.tiles_text("n").alias("tiles"), text.section_text("n", "o_orderkey").alias("section"), text.yes_no(F.col("n") % 3 == 0).alias("flag"))


@query("""SELECT l_linenumber, count(*) AS lines, CASE l_linenumber WHEN 1 THEN 'mvt' WHEN 2 THEN 'png' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'webp' WHEN 5 THEN 'avif' WHEN 6 THEN 'mlt' ELSE 'unknown' END AS tile_type,
  CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN 'gzip' WHEN 3 THEN 'brotli' WHEN 4 THEN 'zstd' ELSE 'unknown' END AS compression FROM lineitem GROUP BY l_linenumber""")
def q_type_names(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("lines"))
    return g.select("l_linenumber", "lines", text.tile_type_name("l_linenumber").alias("tile_type"), text.compression_name("l_linenumber").alias("compression"))


# --- whole archives


def local_path(spark, name: str) -> str:
    """A new file in the shared folder, as executors and the driver see it."""
    at = shared_dir(spark)
    if "://" in at and not at.startswith("file:"):
        raise ValueError(f"archives are files; {at} is no file system that Python opens")
    at = "/" + at.removeprefix("file:").lstrip("/")
    os.makedirs(at, exist_ok=True)
    return f"{at}/{uuid.uuid4().hex}-{name}"


@query("""SELECT n_nationkey, (127 + n_nationkey)::BIGINT AS root_length, n_nationkey::BIGINT * 123456789012 AS data_length, (n_nationkey % 7)::BIGINT AS tile_type, -(n_nationkey::BIGINT * 71234567) AS min_lon_e7, 3::BIGINT AS version FROM nation""")
def q_header_roundtrip(spark, sf_dir):
    """Headers built of columns and read back."""
    k = F.col("n_nationkey").cast("long")
    h = table(spark, sf_dir, "nation").select("n_nationkey", codec.header_bytes({"root_length": 127 + k, "data_length": k * 123456789012, "tile_type": k % 7, "min_lon_e7": -k * 71234567}).alias("content"))
    c = codec.header_columns("content")
    return h.filter(codec.is_archive("content")).select("n_nationkey", *(c[k].alias(k) for k in ("root_length", "data_length", "tile_type", "min_lon_e7", "version")))


@query(f"""WITH RECURSIVE {SQL_DOC_TILES} SELECT tile_id, "offset", length, 1 AS run_length FROM e""")
def q_archive_roundtrip(spark, sf_dir):
    """Documents written as tiles of an archive, and the archive's directories read back."""
    d = table(spark, sf_dir, "documents")
    t = d.select(grid.tile_id(F.lit(24), F.col("doc_id") % 4096, F.call_function("div", F.col("doc_id"), F.lit(4096).cast("long"))).alias("tile_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    path = local_path(spark, "documents.pmtiles")
    archive.write_archive(t, path, "{}", archive.header_for("png", 24, 24, WORLD))
    return read_archive(spark, path)


@query()
def q_render_png(spark, sf_dir):
    """A world raster of 64 x 64 pixels, brighter the more events fall into one, rendered to a pyramid of PNG tiles."""
    import numpy as np

    z = F.lit(6)
    e = points(table(spark, sf_dir, "events"), "event_id").groupBy(grid.lon_to_x("lon", z).alias("x"), grid.lat_to_y("lat", z).alias("y")).agg(F.count("*").alias("n"))
    grey = np.zeros((64, 64), np.uint8)
    for x, y, n in e.collect():  # 4096 rows at most
        grey[y, x] = min(255, 40 * n)
    path = local_path(spark, "world.tif")
    rasters.write_geotiff(path, np.repeat(grey[:, :, None], 3, 2), (-180.0, 360.0 / grey.shape[1], 0.0, 85.0, 0.0, -170.0 / len(grey)), 4326)
    t = keep(render.render(spark, path, render.Options(0, 4, bounds=WORLD, tile_size=64)), "tiles")
    return t.select("tile_id", F.length("data").alias("bytes"), F.hex(F.substring("data", 2, 3)).alias("kind"))
