"""Image encoders on pixel arrays (height, width, bands) of 8 bits. PNG and JPEG are built in; others can be registered."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable

import numpy as np


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray, quality: float = 100) -> bytes:
    """Grey, grey with alpha, RGB or RGBA, by the number of bands. Rows are filtered by their left neighbour where that is smoother."""
    h, w, bands = pixels.shape
    flat = np.ascontiguousarray(pixels, np.uint8).reshape(h, w * bands)
    left = flat.copy()
    left[:, bands:] -= flat[:, :-bands]
    smooth = np.abs(left.view(np.int8).astype(np.int16)).sum(1) < np.abs(flat.view(np.int8).astype(np.int16)).sum(1)
    rows = np.where(smooth[:, None], left, flat)
    body = np.concatenate([smooth.astype(np.uint8)[:, None], rows], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """What png() wrote (filters none and left only)."""
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, _, color = head
    bands = {0: 1, 4: 2, 2: 3, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bands)
    out = raw[:, 1:].reshape(h, w, bands).copy()
    out[raw[:, 0] == 1] = np.cumsum(out[raw[:, 0] == 1], 1, dtype=np.uint8)
    return out


# Fixed values of the standard: how coarsely each frequency is kept at quality 50, brightness and colour, rows by rising frequency.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Diagonal by diagonal, the direction turning each time.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_U = np.arange(8)
DCT = np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16) * np.where(_U == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _code_lengths(freq: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits, no code all ones: frequencies are flattened until they fit."""
    symbols = np.flatnonzero(freq)
    weight = freq[symbols].astype(float)
    while True:
        heap = [(w, i, [int(s)]) for i, (w, s) in enumerate(zip(weight, symbols, strict=True))] + [(0.0, -1, [-1])]  # -1 takes the code of all ones
        depth = dict.fromkeys([-1, *map(int, symbols)], 0)
        heapq.heapify(heap)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            n += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        if max(depth.values()) <= 16:
            return depth
        weight = np.sqrt(weight)


def _huffman(freq: np.ndarray) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as a file has it, and (code, length) of each symbol."""
    depth = _code_lengths(freq)
    order = sorted(depth, key=lambda s: (depth[s], s == -1, s))
    order.remove(-1)
    counts, codes, code, last = bytearray(16), {}, 0, 0
    for s in order:
        n = max(1, depth[s])
        code <<= n - last
        last = n
        codes[s] = code, n
        counts[n - 1] += 1
        code += 1
    return bytes(counts) + bytes(order), codes


def jpeg(pixels: np.ndarray, quality: float = 100) -> bytes:
    """Baseline JPEG without colour subsampling; grey or RGB, alpha is left out. Code tables are made for the image."""
    h, w, bands = pixels.shape
    p = pixels[:, :, : 1 if bands < 3 else 3].astype(float)
    if p.shape[2] == 3:
        r, g, b = p[:, :, 0], p[:, :, 1], p[:, :, 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        p = np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], 2)
    q = min(100, max(1, round(quality)))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    tables = [np.clip(np.floor((np.array(t) * scale + 50) / 100), 1, 255).astype(int) for t in (LUMA, CHROMA)]
    p = np.pad(p, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    rows, cols, n = p.shape[0] // 8, p.shape[1] // 8, p.shape[2]
    blocks = p.reshape(rows, 8, cols, 8, n).transpose(0, 2, 4, 1, 3)
    freq = DCT @ blocks @ DCT.T
    out = np.empty((rows, cols, n, 64), int)
    for c in range(n):
        out[:, :, c] = np.rint(freq[:, :, c].reshape(rows, cols, 64) / tables[min(c, 1)])[:, :, ZIGZAG]
    v = out.reshape(-1, 64)
    kind = np.arange(len(v)) % n
    dc = v[:, 0].copy()
    for c in range(n):
        dc[c::n][1:] -= v[c::n, 0][:-1]
    size = lambda x: int(abs(x)).bit_length()
    stream: list[tuple[int, int, int, int]] = []  # table, symbol, bits, number of bits
    for i in range(len(v)):
        t, k = 2 * min(int(kind[i]), 1), size(dc[i])
        stream.append((t, k, int(dc[i]) + ((1 << k) - 1 if dc[i] < 0 else 0), k))
        at = 0
        for j in np.flatnonzero(v[i, 1:]) + 1:
            run, x = int(j) - at - 1, int(v[i, j])
            stream += [(t + 1, 0xF0, 0, 0)] * (run // 16)
            k = size(x)
            stream.append((t + 1, run % 16 << 4 | k, x + ((1 << k) - 1 if x < 0 else 0), k))
            at = int(j)
        if at < 63:
            stream.append((t + 1, 0, 0, 0))
    count = np.zeros((4, 256), int)
    for t, s, _, _ in stream:
        count[t, s] += 1
    used = range(4 if n == 3 else 2)
    made = [_huffman(count[t]) for t in used]
    value, filled, data = 0, 0, bytearray()
    for t, s, bits, k in stream:
        code, length = made[t][1][s]
        value = (value << length | code) << k | bits
        filled += length + k
        while filled >= 8:
            filled -= 8
            byte = value >> filled
            data.append(byte)
            if byte == 255:
                data.append(0)
            value &= (1 << filled) - 1
    if filled:
        data.append((value << 8 - filled | (1 << 8 - filled) - 1) & 255)
        if data[-1] == 255:
            data.append(0)
    seg = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(seg(0xDB, bytes([t]) + bytes(tables[t][ZIGZAG].tolist())) for t in range(2 if n == 3 else 1))
    head += seg(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n)))
    head += b"".join(seg(0xC4, bytes([t % 2 << 4 | t // 2]) + made[t][0]) for t in used)
    head += seg(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(n)) + bytes([0, 63, 0]))
    return head + bytes(data) + b"\xff\xd9"


ENCODERS: dict[str, Callable[[np.ndarray, float], bytes]] = {"png": png, "jpg": jpeg}


def encoder(fmt: str) -> Callable[[np.ndarray, float], bytes]:
    if fmt not in ENCODERS:
        raise ValueError(f"no encoder for {fmt}; add one to tilewright.operators.encode.ENCODERS")
    return ENCODERS[fmt]
