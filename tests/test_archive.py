import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import codec
from tilewright.operators import archive, encode, render
from tilewright.sources import raster, tiles
from tilewright.sources.archive import headers, read_archive


def test_directory_bytes():
    e = [(1, 0, 10, 1), (2, 10, 20, 1)]
    assert codec.encode_directory(e) == bytes([2, 1, 1, 1, 1, 10, 20, 1, 0])
    assert codec.decode_directory(codec.encode_directory(e)) == e and codec.decode_directory(codec.encode_directory([])) == []


def test_header_round_trip(spark):
    h = codec.Header(root_length=5, data_length=1 << 40, tile_type=4, min_lon_e7=-1800000000, max_zoom=31)
    assert len(h.pack()) == 127 and codec.Header.unpack(h.pack()) == h
    row = headers(spark.createDataFrame([(bytearray(h.pack()),)], "content binary")).first()
    assert (row.root_length, row.data_length, row.tile_type_name, row.min_lon_e7, row.max_zoom) == (5, 1 << 40, "webp", -1800000000, 31)


def test_header_of_columns(spark):
    h = codec.Header(root_length=5, data_length=1 << 40, tile_type=4, min_lon_e7=-1800000000, center_lat_e7=-1, max_zoom=31)
    values = {k: F.lit(getattr(h, k)) for k in ("root_length", "data_length", "tile_type", "min_lon_e7", "center_lat_e7", "max_zoom")}
    assert bytes(spark.range(1).select(codec.header_bytes(values)).first()[0]) == h.pack()


def test_tiles_lie_in_order(spark, tmp_path):
    """Empty tiles among them; tasks write to places of one file."""
    t = spark.range(500).repartition(7).select((F.col("id") * 7919 % 5000).alias("tile_id"), F.expr("cast(repeat(cast(id as string), cast(id % 5 as int)) as binary)").alias("data"))
    h = archive.write_archive(t, f"{tmp_path}/a", "{}", codec.Header())
    want = b"".join(bytes(r.data) for r in t.orderBy("tile_id").collect())
    raw = (tmp_path / "a").read_bytes()
    assert raw[h.data_offset :] == want and len(want) == h.data_length and os.listdir(tmp_path) == ["a"]


@pytest.mark.parametrize("bad", [b"x" * 200, b"PMTiles\x02" + bytes(150), b"PMTiles\x03" + bytes(50)])
def test_bad_archives(spark, bad):
    with pytest.raises(ValueError):
        codec.Header.unpack(bad)
    with pytest.raises(Exception, match="not a tile archive"):
        headers(spark.createDataFrame([(bytearray(bad),)], "content binary")).collect()


def test_leaves_round_trip(spark, tmp_path):
    t = spark.range(9000).select((F.col("id") * 3).alias("tile_id"), F.concat(F.lit("x"), F.col("id").cast("string")).cast("binary").alias("data"))
    h = archive.write_archive(t, f"{tmp_path}/a.pmtiles", "{}", archive.header_for("png", 0, 9, (-1, -1, 1, 1)))
    assert h.leaf_length and h.root_length + codec.HEADER_BYTES <= 16384
    assert read_archive(spark, f"{tmp_path}/a.pmtiles", "tiles").exceptAll(t).count() == 0
    e = read_archive(spark, f"{tmp_path}/a.pmtiles").orderBy("tile_id").collect()
    assert len(e) == 9000 and all(a.offset + a.length == b.offset for a, b in zip(e, e[1:]))
    assert archive.inspect(spark, f"{tmp_path}/a.pmtiles").first().entries == 9000


def test_same_address_twice_raises(spark, tmp_path):
    t = spark.createDataFrame([(1, bytearray(b"a")), (1, bytearray(b"b"))], "tile_id long, data binary")
    with pytest.raises(ValueError):
        archive.write_archive(t, f"{tmp_path}/a", "{}", codec.Header())
    assert not os.listdir(tmp_path)


def make_tree(root, files):
    for f in files:
        os.makedirs(os.path.dirname(f"{root}/{f}"), exist_ok=True)
        open(f"{root}/{f}", "wb").write(f.encode())


def test_pack(spark, tmp_path):
    make_tree(tmp_path / "t", ["0/0/0.png", "1/0/0.PNG", "1/1/1.png", "a/0/0.png", "0/b/0.png", "0/0/c.png", "0/0/0.txt"])
    out = archive.pack(spark, f"{tmp_path}/t", f"{tmp_path}/o.pmtiles", name='say "hi"')
    assert out["tiles"] == 3 and out["format"] == "png" and out["max_zoom"] == 1
    got = {r.tile_id: bytes(r.data) for r in read_archive(spark, f"{tmp_path}/o.pmtiles", "tiles").collect()}
    assert got == {0: b"0/0/0.png", 1: b"1/0/0.PNG", 3: b"1/1/1.png"}
    report = archive.inspect_report(archive.inspect(spark, f"{tmp_path}/o.pmtiles")).first().report
    assert '"name":"say \\"hi\\""' in report and "Zooms                0-1" in report


@pytest.mark.parametrize("files", [["1/2/0.png"], ["32/0/0.png"], ["0/0/0.png", "1/0/0.jpg"], ["0/0/0.txt"]])
def test_pack_errors(spark, tmp_path, files):
    make_tree(tmp_path / "t", files)
    with pytest.raises(Exception):
        archive.pack(spark, f"{tmp_path}/t", f"{tmp_path}/o")


def world(path, bands=3, epsg=4326):
    img = np.random.default_rng(0).integers(0, 255, (60, 120, bands)).astype(np.uint8)
    gt = (-180, 3.0, 0, 90, 0, -3.0) if epsg == 4326 else (-1e7, 1e5, 0, 5e6, 0, -1e5)
    raster.write_geotiff(str(path), img, gt, epsg)
    return img


def test_png_round_trip():
    for bands in (1, 2, 3, 4):
        img = np.random.default_rng(1).integers(0, 255, (9, 7, bands)).astype(np.uint8)
        assert (encode.decode_png(encode.png(img)) == img).all()


@pytest.mark.parametrize(("bands", "quality", "most"), [(3, 100, 2.0), (3, 75, 8.0), (1, 90, 4.0)])
def test_jpeg(spark, tmp_path, bands, quality, most):
    y, x = np.mgrid[0:45, 0:70]
    img = np.stack([128 + 100 * np.sin(x / 9 + c) * np.cos(y / (7 + c)) for c in range(bands)], 2).astype(np.uint8)
    (tmp_path / "t.jpg").write_bytes(encode.jpeg(img, quality))
    got = spark.read.format("image").load(f"{tmp_path}/t.jpg").select("image.*").first()
    back = np.frombuffer(bytes(got.data), np.uint8).reshape(got.height, got.width, got.nChannels)[:, :, ::-1]
    assert (got.height, got.width) == (45, 70) and np.abs(back[:, :, :bands].astype(int) - img).mean() < most


@pytest.mark.parametrize("epsg", [4326, 3857])
def test_chunk_size_does_not_matter(spark, tmp_path, epsg):
    world(tmp_path / "w.tif", epsg=epsg)
    got = [{r.tile_id: bytes(r.data) for r in render.render(spark, f"{tmp_path}/w.tif", render.Options(0, 3, tile_size=16, chunk=c)).collect()} for c in (1, 4, "auto", None)]
    assert got[0] and all(g == got[0] for g in got)


def test_edges(spark, tmp_path):
    world(tmp_path / "g.tif")
    world(tmp_path / "m.tif", epsg=3857)
    w = (-180.0, -85.0, 180.0, 85.0)
    one = lambda f: encode.decode_png(bytes(render.render(spark, f"{tmp_path}/{f}.tif", render.Options(0, 0, bounds=w, tile_size=64)).first().data))
    assert (one("m")[0] == 0).all() and one("g")[0].any()


def test_window_read(tmp_path):
    img = world(tmp_path / "w.tif")
    assert (raster.open_raster(f"{tmp_path}/w.tif").read(5, 7, 50, 40) == img[7:40, 5:50]).all()


def test_strategies():
    s = render.select_strategy
    assert s(3857, True, True, "bilinear") == "same-crs" and s(4326, True, True, "near") == "geographic"
    assert s(4326, True, True, "cubic") == "warp" and s(3857, True, True, "bilinear", "geographic") == "warp" and s(32633, True, True, "bilinear") == "warp"
    assert [render.STRATEGIES[k] for k in ("auto", "same-crs", "geographic", "gdal-warp")] == ["auto", "same-crs", "geographic", "warp"]


def test_raster_archive(spark, tmp_path):
    world(tmp_path / "w.tif")
    out = render.raster(spark, f"{tmp_path}/w.tif", f"{tmp_path}/o.pmtiles", render.Options(0, 2, tile_size=16, resampling="lanczos"))
    assert out["tiles"] == 21 and read_archive(spark, f"{tmp_path}/o.pmtiles").count() == 21


def test_scan_numbers(spark):
    d = spark.createDataFrame([("+5",), ("007",), (" 1",), ("x",), ("99999999999",)], "s string")
    assert [r[0] for r in d.select(tiles.number("s", 255)).collect()] == [5, 7, None, None, None]
