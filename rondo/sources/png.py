"""Images of the PNG format to numbers and back, one at a time: what tasks call on each file's bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of the colour types: grey, RGB, palette, grey and alpha, RGBA


def _chunks(data: bytes) -> dict[bytes, bytes]:
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    found: dict[bytes, bytes] = {}
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        found[name] = found.get(name, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IEND":
            break
    return found


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows (1 + n bytes, the first the filter) with their filters undone; ``step`` bytes lie between a byte and its left neighbour."""
    out = np.zeros((len(raw) + 1, raw.shape[1] - 1 + step), np.int64)  # a row above and a pixel to the left, of zeros
    for y, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:].astype(np.int64), strict=True), 1):
        row, above = out[y], out[y - 1]
        if kind == 0:
            row[step:] = line
        elif kind == 1:
            row[step:] = np.cumsum(line.reshape(-1, step), 0).reshape(-1) & 255
        elif kind == 2:
            row[step:] = (line + above[step:]) & 255
        elif kind in (3, 4):
            for x in range(step, len(row), step):
                a, b, c = row[x - step : x], above[x : x + step], above[x - step : x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                row[x : x + step] = (line[x - step : x] + guess) & 255
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:, step:].astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of bytes; palettes are looked up. Depths below 8 are stretched to bytes, of 16 bits the upper 8 stay."""
    found = _chunks(data)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if interlaced or colour not in _CHANNELS:
        raise ValueError("interlaced images are not read")
    channels = _CHANNELS[colour]
    length = (width * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, 1 + length)
    rows = _unfiltered(raw, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, : width * channels]
        rows = bits @ (1 << np.arange(depth)[::-1])
        rows = rows if colour == 3 else rows * 255 // ((1 << depth) - 1)
    image = rows.astype(np.uint8).reshape(height, width, channels)
    return np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)[image[:, :, 0]] if colour == 3 else image


def encode(image: np.ndarray) -> bytes:
    """Bytes of (height, width, channels) as a file without row filters."""
    height, width, channels = image.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.column_stack([np.zeros(height, np.uint8), image.reshape(height, -1)])
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
