"""Image bytes to arrays within the Python worker: JPEG, and a small PNG codec (8-bit, not interlaced)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessella.sources.jpeg import decode_jpeg

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_image(data: bytes | None, most: int = 1 << 26) -> np.ndarray | None:
    """(H, W, 3) of uint8 by the bytes' signature; None for what can't be decoded."""
    return decode_jpeg(data, most) if data and bytes(data[:2]) == b"\xff\xd8" else decode_png(data, most)


def encode_png(pixels: np.ndarray) -> bytes:
    """(H, W) or (H, W, 3) of uint8."""
    h, w = pixels.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes | None, most: int = 1 << 26) -> np.ndarray | None:
    """(H, W, 3) of uint8; None for what is no such image."""
    try:
        if not data or data[:8] != SIGNATURE:
            return None
        at, parts = 8, []
        w = h = depth = kind = lace = 0
        while at + 8 <= len(data):
            (size,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if name == b"IHDR":
                w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            elif name == b"IDAT":
                parts.append(body)
            elif name == b"IEND":
                break
            at += 12 + size
        c = CHANNELS.get(kind)
        if c is None or depth != 8 or lace or not w or not h or w * h * c > most:
            return None
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), h * (w * c + 1)), np.uint8).reshape(h, w * c + 1)
        return _to_rgb(_unfiltered(raw, h, w, c))
    except (struct.error, zlib.error, ValueError):
        return None


def _unfiltered(raw: np.ndarray, h: int, w: int, c: int) -> np.ndarray:
    out = np.zeros((h, w, c), np.uint8)
    above = np.zeros((w, c), np.uint8)
    for y in range(h):
        line = raw[y, 1:].reshape(w, c)
        match raw[y, 0]:
            case 0:
                row = line
            case 1:
                row = np.cumsum(line, axis=0, dtype=np.uint8)
            case 2:
                row = line + above
            case kind:
                row = np.zeros((w, c), np.uint8)
                left, corner = np.zeros(c, int), np.zeros(c, int)
                for x in range(w):
                    up = above[x].astype(int)
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        a, b, d = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
                    row[x] = (line[x] + guess) % 256
                    left, corner = row[x].astype(int), up
        out[y] = row
        above = out[y]
    return out


def _to_rgb(pixels: np.ndarray) -> np.ndarray:
    c = pixels.shape[2]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if c <= 2 else pixels[:, :, :3]
