"""Georeferenced rasters: a reader of GeoTIFF and BigTIFF files that decodes only the strips or blocks it needs, with their overviews."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, BANDS, ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
BLOCK_W, BLOCK_H, BLOCK_AT, BLOCK_SIZE, SUBFILE = 322, 323, 324, 325, 254
PIXEL_SCALE, TIEPOINT, GEO_KEYS = 33550, 33922, 34735
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 18: "Q"}


#: Bytes of decoded blocks that a task keeps of a raster, one block at least.
CACHE = 64 << 20


@dataclass
class Raster:
    """width, height, bands of 8 bits; gt: geotransform (x of the corner, pixel width, row turn, y, column turn, pixel height); epsg.
    overviews: the same area in fewer pixels, largest first."""

    path: str
    width: int
    height: int
    bands: int
    gt: tuple[float, ...] | None
    epsg: int | None
    block: tuple[int, int]
    places: list[tuple[int, int]]
    compression: int
    predictor: int
    bits: int
    overviews: list[Raster] = field(default_factory=list)
    _cache: dict = field(default_factory=dict, repr=False)

    def _block(self, i: int) -> np.ndarray:
        if i not in self._cache:
            if (len(self._cache) + 1) * self.block[0] * self.block[1] * self.bands > CACHE:
                self._cache.clear()
            at, size = self.places[i]
            with open(self.path, "rb") as f:
                f.seek(at)
                raw = f.read(size)
            if self.compression in (8, 32946):
                raw = zlib.decompress(raw)
            h, w = self.block
            a = np.frombuffer(raw, np.uint8)
            a = np.pad(a, (0, max(0, h * w * self.bands - len(a))))[: h * w * self.bands].reshape(h, w, self.bands)
            self._cache[i] = np.cumsum(a, 1, dtype=np.uint8) if self.predictor == 2 else a
        return self._cache[i]

    def read(self, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        """Pixels of a window inside the raster (rows, columns, bands)."""
        out = np.empty((y1 - y0, x1 - x0, self.bands), np.uint8)
        h, w = self.block
        across = -(-self.width // w)
        for by in range(y0 // h, -(-y1 // h)):
            for bx in range(x0 // w, -(-x1 // w)):
                ya, yb, xa, xb = max(y0, by * h), min(y1, by * h + h), max(x0, bx * w), min(x1, bx * w + w)
                out[ya - y0 : yb - y0, xa - x0 : xb - x0] = self._block(by * across + bx)[ya - by * h : yb - by * h, xa - bx * w : xb - bx * w]
        return out

    def pick(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Pixels where rows and columns inside the raster cross (rows, columns, bands). Blocks without any are not decoded, the others once."""
        out = np.empty((len(rows), len(cols), self.bands), np.uint8)
        h, w = self.block
        across = -(-self.width // w)
        to = [(bx, np.flatnonzero(cols // w == bx)) for bx in np.unique(cols // w).tolist()]
        for by in np.unique(rows // h).tolist():
            at = np.flatnonzero(rows // h == by)
            for bx, c in to:
                out[np.ix_(at, c)] = self._block(by * across + bx)[np.ix_(rows[at] - by * h, cols[c] - bx * w)]
        return out

    @property
    def north_up(self) -> bool:
        g = self.gt
        return bool(g) and abs(g[2]) <= 1e-12 and abs(g[4]) <= 1e-12 and g[1] > 0 > g[5]


def _directory(f, at: int, order: str, big: bool) -> tuple[dict, int]:
    """Values by tag of the directory at a place, and where the next one lies."""
    count, entry, place, inline = ("Q", "HHQ8s", "Q", 8) if big else ("H", "HHI4s", "I", 4)
    get = lambda code: struct.unpack(order + code, f.read(struct.calcsize(order + code)))
    f.seek(at)
    tags = {}
    for _ in range(get(count)[0]):
        tag, kind, n, value = get(entry)
        if kind not in _TYPES:
            continue
        code = f"{order}{n * len(_TYPES[kind])}{_TYPES[kind][0]}"
        size, here = struct.calcsize(code), f.tell()
        if size > inline:
            f.seek(struct.unpack(order + place, value)[0])
            value = f.read(size)
        tags[tag] = struct.unpack(code, value[:size])
        f.seek(here)
    return tags, get(place)[0]


def _image(path: str, tags: dict) -> Raster:
    one = lambda t, default=None: tags[t][0] if t in tags else default
    bands, bits = one(BANDS, 1), max(tags.get(BITS, (1,)))
    if one(PLANAR, 1) != 1 and bands > 1 or one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError("only pixel-interleaved TIFF files without compression or with deflate are read")
    w, h = one(WIDTH), one(HEIGHT)
    block = (one(BLOCK_H), one(BLOCK_W)) if BLOCK_W in tags else (min(h, one(ROWS, h)), w)
    places = list(zip(*((tags[BLOCK_AT], tags[BLOCK_SIZE]) if BLOCK_W in tags else (tags[STRIP_AT], tags[STRIP_SIZE])), strict=True))
    gt = epsg = None
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[PIXEL_SCALE], tags[TIEPOINT][:6]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    keys = tags.get(GEO_KEYS, ())
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0:
            epsg = keys[k + 3] if keys[k] == 3072 or epsg is None else epsg
    return Raster(path, w, h, bands, gt, epsg, block, places, one(COMPRESSION, 1), one(PREDICTOR, 1), bits)


def open_raster(path: str) -> Raster:
    """The file's first image; later ones marked as the same in fewer pixels are its overviews if their bands and compression are read here."""
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        kind = struct.unpack(order + "H", f.read(2))[0] if order else None
        if kind not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = kind == 43
        at = struct.unpack(order + "4xQ", f.read(12))[0] if big else struct.unpack(order + "I", f.read(4))[0]
        found, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(f, at, order, big)
            found.append(tags)
    r = _image(path, found[0])
    for tags in found[1:]:
        if tags.get(SUBFILE) != (1,):
            continue
        try:
            o = _image(path, tags)
        except ValueError:
            continue
        if (o.bands, o.bits) == (r.bands, r.bits) and o.width < r.width:
            if r.gt:
                x, wide, a, y, b, high = r.gt
                o.gt = (x, wide * r.width / o.width, a, y, b, high * r.height / o.height)
            o.epsg = r.epsg
            r.overviews.append(o)
    r.overviews.sort(key=lambda o: -o.width)
    return r


def halved(pixels: np.ndarray) -> np.ndarray:
    """Means of two by two pixels; an odd last row or column counts twice."""
    p = np.pad(pixels, ((0, pixels.shape[0] % 2), (0, pixels.shape[1] % 2), (0, 0)), "edge").astype(np.uint16)
    return ((p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2] + 2) // 4).astype(np.uint8)


def write_geotiff(path: str, pixels: np.ndarray, gt, epsg: int, rows: int = 16, deflate: bool = True, overviews: int = 0, big: bool = False) -> None:
    """A strip-wise file of 8-bit pixels, each overview half as wide and high as the one before. big: with 64-bit places."""
    count, place = ("Q", "Q") if big else ("H", "I")
    inline = struct.calcsize(place)
    geo = (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHH", b"II", 43, 8, 0) if big else b"II*\0")
        link = f.tell()  # where the next directory's place is written once it is known
        f.write(bytes(inline))
        for level in range(overviews + 1):
            pixels = halved(pixels) if level else pixels
            h, w, bands = pixels.shape
            offsets, sizes = [], []
            for i in range(0, h, rows):
                strip = np.ascontiguousarray(pixels[i : i + rows]).tobytes()
                strip = zlib.compress(strip) if deflate else strip
                offsets.append(f.tell())
                sizes.append(f.write(strip))
            wide = 16 if big else 4
            tags = [
                (SUBFILE, 4, (min(level, 1),)), (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (8,) * bands), (COMPRESSION, 3, (8 if deflate else 1,)), (262, 3, (2 if bands > 2 else 1,)), (STRIP_AT, wide, offsets), (BANDS, 3, (bands,)), (ROWS, 4, (rows,)),
                (STRIP_SIZE, wide, sizes), (PLANAR, 3, (1,)),
            ]
            if not level:
                tags += [(PIXEL_SCALE, 12, (gt[1], -gt[5], 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, gt[0], gt[3], 0.0)), (GEO_KEYS, 3, geo)]
            at, extra, entries = f.tell(), b"", b""
            base = at + struct.calcsize("<" + count) + len(tags) * (4 + 2 * inline) + inline
            for tag, kind, values in tags:
                raw = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
                if len(raw) <= inline:
                    value = raw.ljust(inline, b"\0")
                else:
                    value = struct.pack("<" + place, base + len(extra))
                    extra += raw + b"\0" * (len(raw) % 2)
                entries += struct.pack("<HH" + place, tag, kind, len(values)) + value
            f.write(struct.pack("<" + count, len(tags)) + entries + bytes(inline) + extra)
            end = f.tell()
            f.seek(link)
            f.write(struct.pack("<" + place, at))
            f.seek(end)
            link = base - inline
