"""Pixels against a calculation pixel by pixel, and what is read of a raster."""

import math

import numpy as np
import pytest

from tilewright.operators import render
from tilewright.sources import raster

HALF = math.pi * 6378137.0


def source(path, epsg, h=30, w=60, **more):
    img = np.random.default_rng(3).integers(0, 256, (h, w, 3)).astype(np.uint8)
    gt = (-180.0, 360 / w, 0, 90.0, 0, -180 / h) if epsg == 4326 else (-HALF, 2 * HALF / w, 0, HALF, 0, -2 * HALF / h)
    raster.write_geotiff(str(path), img, gt, epsg, **more)
    return img, gt, raster.open_raster(str(path))


def place(gt, epsg, x, y, across):
    """Column and row, counted from pixel centres, of a target pixel's centre."""
    mx, my = (x + 0.5) / across * 2 * HALF - HALF, HALF - (y + 0.5) / across * 2 * HALF
    if epsg == 4326:
        mx, my = mx / HALF * 180, math.degrees(math.atan(math.sinh(my / HALF * math.pi)))
    return (mx - gt[0]) / gt[1] - 0.5, (my - gt[3]) / gt[5] - 0.5


def tent(p, n, stay):
    """The two neighbours of a place with their weights; those outside go to the edge (stay) or weigh nothing."""
    a = math.floor(p)
    pairs = [(a, 1 - (p - a)), (a + 1, p - a)]
    pairs = [(min(max(i, 0), n - 1), w) for i, w in pairs] if stay else [(i, w) for i, w in pairs if 0 <= i < n]
    return [(i, w / sum(w for _, w in pairs)) for i, w in pairs]


@pytest.mark.parametrize(("epsg", "strategy", "kernel"), [(4326, "geographic", "bilinear"), (3857, "same-crs", "bilinear"), (4326, "geographic", "nearest"), (3857, "same-crs", "nearest")])
def test_pixels(tmp_path, epsg, strategy, kernel):
    img, gt, r = source(tmp_path / "a.tif", epsg)
    across = 256.0  # finer than the source
    px, py = np.arange(0, 256, 3, dtype=float), np.arange(0, 256, 5, dtype=float)
    got = render.render_area(r, px, py, across, strategy, kernel).astype(int)
    for j, y in enumerate(py):
        for i, x in enumerate(px):
            c, w = place(gt, epsg, x, y, across)
            if kernel == "nearest":
                want = img[min(max(math.floor(w + 0.5), 0), 29), min(max(math.floor(c + 0.5), 0), 59)].astype(float)
            else:
                stay = strategy == "geographic"
                want = sum(img[b, a] * (u * v) for b, u in tent(w, 30, stay) for a, v in tent(c, 60, stay))
            assert np.abs(got[j, i] - want).max() <= 0.5 + 1e-6


def test_average_of_whole_pixels(tmp_path):
    img, _, r = source(tmp_path / "a.tif", 3857, 64, 64)
    got = render.render_area(r, np.arange(8.0), np.arange(8.0), 8.0, "warp", "average").astype(int)
    assert np.abs(got - img.reshape(8, 8, 8, 8, 3).mean((1, 3))).max() <= 0.5 + 1e-6


@pytest.mark.parametrize("big", [False, True])
def test_overviews(tmp_path, big):
    img, _, r = source(tmp_path / "a.tif", 3857, 64, 64, overviews=3, big=big)
    assert [(o.width, o.height) for o in r.overviews] == [(32, 32), (16, 16), (8, 8)] and r.gt[1] * 64 == r.overviews[2].gt[1] * 8
    assert (r.read(0, 0, 64, 64) == img).all() and (r.overviews[0].read(0, 0, 32, 32) == raster.halved(img)).all()
    got = render.render_area(r, np.arange(8.0), np.arange(8.0), 8.0, "same-crs", "bilinear")
    assert (got == r.overviews[2].read(0, 0, 8, 8)).all()
    assert not r.overviews[1]._cache and np.abs(got - img.reshape(8, 8, 8, 8, 3).mean((1, 3))).max() <= 2  # means rounded three times


@pytest.mark.parametrize(("epsg", "kernel"), [(3857, "lanczos"), (4326, "cubic"), (4326, "average")])
def test_parts_do_not_matter(tmp_path, monkeypatch, epsg, kernel):
    _, _, r = source(tmp_path / "a.tif", epsg, 90, 180, overviews=2)
    area = lambda: render.render_area(r, np.arange(64.0), np.arange(64.0), 64.0, "warp", kernel)
    whole = area()
    monkeypatch.setattr(render, "SOURCE", 1)
    assert whole.any() and (area() == whole).all()
    split = np.concatenate([render.render_area(r, np.arange(64.0), np.arange(a, a + 16.0), 64.0, "warp", kernel) for a in range(0, 64, 16)])
    assert (split == whole).all()


def test_low_zoom_reads_few_strips(tmp_path):
    """Strips between the rows that have taps are not decoded."""
    _, _, r = source(tmp_path / "a.tif", 4326, 4000, 40, rows=1)
    render.render_area(r, np.arange(8.0), np.arange(8.0), 8.0, "geographic", "bilinear")
    assert 8 <= len(r._cache) <= 16


def test_pick(tmp_path):
    img, _, r = source(tmp_path / "a.tif", 4326, rows=7)
    rows, cols = np.array([0, 6, 7, 29]), np.array([3, 59])
    assert (r.pick(rows, cols) == img[np.ix_(rows, cols)]).all()
