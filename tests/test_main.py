"""The command line: values, refusals, exit codes."""

import numpy as np
import pytest

from tilewright import __main__ as cli
from tilewright.operators import render
from tilewright.sources import raster


def test_negative_bounds():
    a = cli.parser().parse_args(cli.joined(["raster", "in", "out", "--zoom", "0-3", "--bounds", "-126,24,-59,50"]))
    assert a.bounds == (-126, 24, -59, 50) and a.zoom == (0, 3)


@pytest.mark.parametrize(("text", "n"), [("1.5G", 3 << 29), ("512", 512 << 20), ("0.5k", 512), (" 4M ", 4 << 20)])
def test_memory(text, n):
    assert cli.memory(text) == n


@pytest.mark.parametrize("text", ["0", "-1G", "inf", "nan", "x", ""])
def test_no_memory(text):
    with pytest.raises((ValueError, cli.argparse.ArgumentTypeError)):
        cli.memory(text)


@pytest.mark.parametrize("option", ["--warp-threads=4", "--webp-method", "--warp-option=a=b", "--open-option", "--gdal-cache=1"])
def test_refused_by_name(option, capsys):
    assert cli.main(["raster", "in", "out", "--zoom", "0", option]) == 1
    assert option.split("=")[0] in capsys.readouterr().err


def test_exit_codes(capsys):
    assert cli.main(["raster"]) == 1 and cli.main(["--help"]) == 0 and cli.main([]) == 0


def test_plan(spark, tmp_path, capsys):
    raster.write_geotiff(f"{tmp_path}/a.tif", np.zeros((8, 16, 1), np.uint8), (-180.0, 22.5, 0, 90.0, 0, -22.5), 4326, overviews=1)
    lines = render.plan_report(spark, f"{tmp_path}/a.tif", render.Options(0, 1, tile_size=16)).split("\n")
    assert "  tiles: 5" in lines and "  16 x 8, 1 bands, EPSG:4326, 1 overviews" in lines and "  strategy: geographic" in lines
    assert any(x.startswith("  first tile: 0/0/0, id 0, bounds -180.0000000, -85.0511288, 180.0000000, 85.0511288") for x in lines)
    assert [x.split(",")[0] for x in lines[lines.index("Zooms") + 1 :]] == ["  0: 1 tiles", "  1: 4 tiles"]
