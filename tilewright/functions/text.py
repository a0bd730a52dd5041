"""Texts of reports and of archive metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import _c

# Fixed values of the archive format: codes and their names.
TILE_TYPES = {1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif", 6: "mlt"}
COMPRESSIONS = {1: "none", 2: "gzip", 3: "brotli", 4: "zstd"}
#: Extensions of tile files, and the format each means.
EXTENSIONS = {"png": "png", "jpg": "jpg", "jpeg": "jpg", "webp": "webp", "avif": "avif"}
FORMAT_CODES = {"png": 2, "jpg": 3, "webp": 4, "avif": 5}
#: Whole numbers of any size that texts are made of; longs are too short for some.
WHOLE = "decimal(38,0)"


def _named(code, names: dict) -> Column:
    out = F.lit("unknown")
    for k, v in names.items():
        out = F.when(_c(code) == k, v).otherwise(out)
    return out


def tile_type_name(code) -> Column:
    return _named(code, TILE_TYPES)


def compression_name(code) -> Column:
    return _named(code, COMPRESSIONS)


def format_of_extension(ext) -> Column:
    """png, jpg, webp or avif; null for anything else. Case does not matter."""
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(F.lower(_c(ext)) == k, v).otherwise(out)
    return out


def count_text(n) -> Column:
    return F.format_number(_c(n).cast(WHOLE), 0)


def bytes_text(n) -> Column:
    """Bytes as B, or with one decimal as KiB to TiB; null for null. Units are of n as a double, rounded as C does: by its exact
    value, ties to even. (Java's %.1f rounds the shortest digits, ties up.) All digits are exact below 2^93 bytes."""
    n = _c(n).cast(WHOLE)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << 10 * i, F.concat(F.call_function("format_number", n.cast("double") / float(1 << 10 * i), F.lit("0.0")), F.lit(f" {unit}"))).otherwise(out)
    return out


def bounds_text(west, south, east, north) -> Column:
    return F.format_string("%.7f, %.7f, %.7f, %.7f", *map(_c, (west, south, east, north)))


def yes_no(flag) -> Column:
    return F.when(_c(flag), "yes").otherwise("no")


def tiles_text(n) -> Column:
    n = _c(n).cast(WHOLE)
    return F.concat(count_text(n), F.when(n == 1, " tile").otherwise(" tiles"))


def section_text(length, offset) -> Column:
    return F.concat(_c(length).cast(WHOLE).cast("string"), F.lit(" @ "), _c(offset).cast(WHOLE).cast("string"))


def field_text(label: str, value, width: int = 20) -> Column:
    return F.concat(F.lit(f"  {label:<{width}} "), _c(value).cast("string"))


def json_escape(s) -> Column:
    """Quotes, backslashes, line feeds, carriage returns and tabs escaped; other control characters as \\u00XX."""
    out = _c(s)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for i in [*range(9), 11, 12, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return out


def metadata_json(name, description, attribution, fmt, tile_size, min_zoom, max_zoom, west, south, east, north) -> Column:
    """An archive's metadata. Null name: a fixed text; null description: the name; null attribution: empty."""
    name = F.coalesce(_c(name), F.lit("tiles"))
    w, s, e, n = map(_c, (west, south, east, north))
    return F.format_string(
        '{"name":"%s","description":"%s","attribution":"%s","type":"overlay","version":"1.0.0","format":"%s","tileSize":%d,"minzoom":%d,"maxzoom":%d,"bounds":[%.7f,%.7f,%.7f,%.7f],"center":[%.7f,%.7f,%d]}',
        json_escape(name), json_escape(F.coalesce(_c(description), name)), json_escape(F.coalesce(_c(attribution), F.lit(""))), _c(fmt), _c(tile_size).cast("long"), _c(min_zoom).cast("int"), _c(max_zoom).cast("int"),
        w, s, e, n, (w + e) / 2, (s + n) / 2, _c(min_zoom).cast("int"),
    )
