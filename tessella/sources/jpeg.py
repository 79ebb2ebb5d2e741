"""A JPEG decoder in numpy: 8-bit baseline, extended and progressive Huffman images, any sampling, restarts.

Written from the public standard (ITU-T T.81). Entropy decoding fills an array of coefficients per component, which one
matrix product turns into samples; smaller components are enlarged by repetition.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# The zigzag order of the standard, as positions in a block of 8 rows of 8.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_K, _X = np.arange(8)[:, None], np.arange(8)[None, :]
#: COSINES[u, x]: the value at x of the basis function u.
COSINES = np.where(_K == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _X + 1) * _K * np.pi / 16)
MARKER = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")  # ends a scan's data: neither a stuffed byte nor a restart


class BadJpeg(ValueError):
    """What is no image of the supported kinds."""


@dataclass
class Component:
    key: int
    across: int
    down: int
    table: int
    coefficients: np.ndarray = field(default=None)
    width: int = 0
    height: int = 0
    last: int = 0  # the DC value before


class Bits:
    """Bits of one restart interval, with ones after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        chunk = self.data[self.at : self.at + 6].ljust(6, b"\xff")
        self.at += 6
        if self.at > len(self.data) + 4096:
            raise BadJpeg("a scan ends early")
        self.held = (self.held & (1 << self.n) - 1) << 48 | int.from_bytes(chunk, "big")
        self.n += 48

    def take(self, n: int) -> int:
        if self.n < n:
            self.fill()
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, codes: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = codes[self.held >> self.n - 16 & 0xFFFF]
        if not found:
            raise BadJpeg("no such code")
        self.n -= found >> 8
        return found & 255

    def signed(self, size: int) -> int:
        """A value of ``size`` bits; those that begin with 0 are negative."""
        if not size:
            return 0
        v = self.take(size)
        return v if v >> size - 1 else v - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: the length of the code they begin with, times 256, plus its symbol; 0 for no code."""
    out, at, k = [0] * 65536, 0, 0
    for size, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            span = 1 << 16 - size
            out[at : at + span] = [size << 8 | s] * span
            at += span
        k += n
    if at > 65536:
        raise BadJpeg("too many codes")
    return out


class Decoder:
    def __init__(self, data: bytes, most: int):
        self.data, self.most = data, most
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], list[int]] = {}
        self.components: list[Component] = []
        self.restart, self.adobe, self.progressive = 0, None, False
        self.width = self.height = 0

    def decode(self) -> np.ndarray:
        data, at = self.data, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise BadJpeg("a marker is missing")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                self.quantise(body)
            elif kind == 0xC4:
                self.huffman(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self.frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise BadJpeg("lossless, hierarchical or arithmetic coding")
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body[:2])
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif kind == 0xDA:
                end = MARKER.search(data, at)
                stop = end.start() if end else len(data)
                self.scan(body, data[at:stop])
                at = stop
        if not self.components:
            raise BadJpeg("no frame")
        return self.colours(np.stack([self.samples(c) for c in self.components], axis=2))

    def quantise(self, body: bytes) -> None:
        while body:
            wide, key = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quantisers[key] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1", 64).astype(np.int64)
            body = body[1 + size :]

    def huffman(self, body: bytes) -> None:
        while len(body) >= 17:
            counts = body[1:17]
            n = sum(counts)
            self.codes[body[0] >> 4, body[0] & 15] = _codes(counts, body[17 : 17 + n])
            body = body[17 + n :]

    def frame(self, body: bytes, progressive: bool) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or n not in (1, 3, 4) or not self.width or not self.height or self.width * self.height * n > self.most or self.components:
            raise BadJpeg("an unsupported or too large frame")
        self.progressive = progressive
        for key, sampling, table in struct.iter_unpack("BBB", body[6 : 6 + 3 * n]):
            self.components.append(Component(key, sampling >> 4, sampling & 15, table))
        if not all(1 <= c.across <= 4 and 1 <= c.down <= 4 for c in self.components):
            raise BadJpeg("sampling factors")
        self.across, self.down = max(c.across for c in self.components), max(c.down for c in self.components)
        self.columns, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for c in self.components:
            c.width, c.height = -(-self.width * c.across // self.across), -(-self.height * c.down // self.down)
            c.coefficients = np.zeros((self.rows * c.down, self.columns * c.across, 64), np.int32)

    def scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        chosen = []
        for key, tables in struct.iter_unpack("BB", head[1 : 1 + 2 * n]):
            chosen.append((next(c for c in self.components if c.key == key), tables >> 4, tables & 15))
        first, last, bits = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n]
        high, low = bits >> 4, bits & 15
        parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff+[\xd0-\xd7]", data)]
        blocks = self.order([c for c, _, _ in chosen])
        every = self.restart or len(blocks)
        for k, at in enumerate(range(0, len(blocks), every)):
            if k >= len(parts):
                raise BadJpeg("a restart interval is missing")
            source, self.run = Bits(parts[k]), 0
            for c, _, _ in chosen:
                c.last = 0
            for unit in blocks[at : at + every]:
                for i, row, column in unit:
                    c, dc, ac = chosen[i]
                    self.block(source, c, c.coefficients[row, column], dc, ac, first, last, high, low)

    def order(self, components: list[Component]) -> list[list[tuple[int, int, int]]]:
        """The units of a scan, each a list of (component, row, column) of blocks."""
        if len(components) == 1:
            c = components[0]
            return [[(0, y, x)] for y in range(-(-c.height // 8)) for x in range(-(-c.width // 8))]
        inner = [(i, y, x) for i, c in enumerate(components) for y in range(c.down) for x in range(c.across)]
        return [[(i, v * components[i].down + y, u * components[i].across + x) for i, y, x in inner] for v in range(self.rows) for u in range(self.columns)]

    def block(self, source: Bits, c: Component, out: np.ndarray, dc: int, ac: int, first: int, last: int, high: int, low: int) -> None:
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if first == 0:
            if high:
                out[0] |= source.take(1) << low
            else:
                c.last += source.signed(source.symbol(self.codes[0, dc]))
                out[0] = c.last << low
            first = 1
        if last:
            (self.refine if high else self.spectrum)(source, out, self.codes[1, ac], first, last, low)

    def spectrum(self, source: Bits, out: np.ndarray, codes: list[int], k: int, last: int, low: int) -> None:
        """New coefficients: runs of zeros and values; a run may end this block and ones after it."""
        if self.run:
            self.run -= 1
            return
        while k <= last:
            s = source.symbol(codes)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                if k > 63:
                    raise BadJpeg("a block is too long")
                out[k] = source.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                if self.progressive:
                    self.run = (1 << zeros) - 1 + (source.take(zeros) if zeros else 0)
                return

    def refine(self, source: Bits, out: np.ndarray, codes: list[int], k: int, last: int, low: int) -> None:
        """One more bit of known coefficients, and new ones of that size between them."""
        bit = 1 << low

        def correct(k: int) -> None:
            if source.take(1) and not abs(int(out[k])) & bit:
                out[k] += bit if out[k] > 0 else -bit

        while k <= last and not self.run:
            s = source.symbol(codes)
            zeros, size = s >> 4, s & 15
            value = 0
            if size:
                value = bit if source.take(1) else -bit
            elif zeros < 15:
                self.run = (1 << zeros) + (source.take(zeros) if zeros else 0)
                break
            while k <= last:
                if out[k]:
                    correct(k)
                elif zeros == 0:
                    if value:
                        out[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if self.run:
            for j in range(k, last + 1):
                if out[j]:
                    correct(j)
            self.run -= 1

    def samples(self, c: Component) -> np.ndarray:
        if c.table not in self.quantisers:
            raise BadJpeg("no quantisation table")
        rows, columns, _ = c.coefficients.shape
        blocks = np.zeros((rows, columns, 64))
        blocks[:, :, ZIGZAG] = c.coefficients * self.quantisers[c.table]
        blocks = np.einsum("ux,rcuv,vy->rcxy", COSINES, blocks.reshape(rows, columns, 8, 8), COSINES, optimize=True)
        plane = np.clip(np.rint(blocks) + 128, 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        y = np.minimum(np.arange(self.height) * c.down // self.down, c.height - 1)
        x = np.minimum(np.arange(self.width) * c.across // self.across, c.width - 1)
        return plane[y[:, None], x]

    def colours(self, planes: np.ndarray) -> np.ndarray:
        n = planes.shape[2]
        if n == 1:
            return np.repeat(planes, 3, axis=2).astype(np.uint8)
        named = bytes(c.key for c in self.components[:3]) == b"RGB"
        if self.adobe in (1, 2) or (self.adobe is None and n == 3 and not named):
            y, cb, cr = planes[:, :, 0], planes[:, :, 1] - 128, planes[:, :, 2] - 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
            planes = np.concatenate([np.clip(rgb, 0, 255), planes[:, :, 3:]], axis=2)
        if n == 4:  # inks, stored inverted by the writers that mark their files
            inks = planes if self.adobe is not None else 255 - planes
            planes = inks[:, :, :3] * inks[:, :, 3:] / 255
        return np.rint(planes).astype(np.uint8)


def decode_jpeg(data: bytes | None, most: int = 1 << 26) -> np.ndarray | None:
    """(H, W, 3) of uint8; None for what can't be decoded."""
    try:
        return Decoder(bytes(data), most).decode() if data and bytes(data[:2]) == b"\xff\xd8" else None
    except (BadJpeg, struct.error, KeyError, IndexError, ValueError, StopIteration, OverflowError):
        return None
