"""TIFF as a media column: image directories, PackBits, LZW and deflate strips and tiles, horizontal predictor.

Reading walks the chain of image directories and gives one row per page; writing lays bytes out as pages of 8-bit
samples. Classic TIFF with 8- or 16-bit samples, chunky or in planes, in either byte order is understood.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import tidy
from tessella.shipping import ship

# Fixed values of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 284, 317, 322, 323, 324, 325
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {RAW: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
FORMATS = {1: "B", 3: "H", 4: "I"}
CLEAR, END, FIRST_FREE, LAST_CODE = 256, 257, 258, 4094

RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class BadTiff(ValueError):
    """The bytes are no TIFF file that this module reads."""


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literals(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in RUN.finditer(data):
        literals(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.extend(m[1])
        at = m.end()
    literals(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def widths(n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code: 9 to 12, one code early, as readers expect."""
    free = FIRST_FREE + np.arange(n)
    return 9 + (free >= 512).astype(np.int64) + (free >= 1024) + (free >= 2048)


def lzw_encode(data: bytes) -> bytes:
    """Codes from 9 to 12 bits, most significant bit first."""
    codes, sizes = [CLEAR], [widths(1)]
    table: dict[int, int] = {}
    free, began, code = FIRST_FREE, 1, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        longer = table.get(key)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        table[key] = free
        free += 1
        if free > LAST_CODE:
            codes.append(CLEAR)
            sizes.append(widths(len(codes) - began))
            table, free, began = {}, FIRST_FREE, len(codes)
        code = byte
    if code >= 0:
        codes.append(code)
    codes.append(END)
    sizes.append(widths(len(codes) - began))
    values, size = np.array(codes)[:, None], np.concatenate(sizes)[:, None]
    bit = np.arange(12)[None, :]
    return np.packbits((values >> np.maximum(size - 1 - bit, 0) & 1).astype(np.uint8)[bit < size]).tobytes()


def _codes(data: bytes) -> Iterator[tuple[bool, list[int]]]:
    """(whether a clear code came before, codes) in stretches, up to the end code."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    at, done, fresh = 0, 0, True
    while True:
        size = widths(done + 4096)[done:]
        place = at + np.cumsum(size) - size
        inside = place + size <= 8 * len(data)
        size, place = size[inside], place[inside]
        if not len(size):
            return
        byte = place >> 3
        window = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
        codes = window >> 32 - (place & 7) - size & (1 << size) - 1
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else len(codes)
        yield fresh, codes[:n].tolist()
        if not len(stop):
            at, done, fresh = int(place[-1] + size[-1]), done + n, False
        elif codes[n] == END:
            return
        else:
            at, done, fresh = int(place[n] + size[n]), 0, True


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, made = base.copy(), b"", 0
    out: list[bytes] = []
    for fresh, codes in _codes(data):
        if fresh:
            table, last = base.copy(), b""
        for code in codes:
            if last:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise BadTiff("LZW code out of range")
                table.append(last + entry[:1])
            else:
                if code > 255:
                    raise BadTiff("LZW data begin with no sample")
                entry = table[code]
            out.append(entry)
            last = entry
            made += len(entry)
        if made >= size:
            break
    return b"".join(out)


def compress(data: bytes, kind: int) -> bytes:
    return {RAW: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}[kind](data)


def decompress(data: bytes, kind: int, size: int) -> bytes:
    """``size`` bytes, or :class:`BadTiff`; never more, whatever the data say."""
    if kind == RAW:
        out = bytes(data)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from None
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise BadTiff(f"compression {kind}")
    if len(out) < size:
        raise BadTiff("too few samples")
    return out[:size]


@dataclass
class Page:
    """One image: ``pixels`` is (height, width, samples) of unsigned 8- or 16-bit values; ``planes``: stored one by one."""

    pixels: np.ndarray
    compression: int = DEFLATE
    predictor: int = 1
    tile: int = 0  # side of square tiles, or 0 for strips
    rows_per_strip: int = 128
    planes: bool = False


def _blocks(page: Page) -> list[bytes]:
    blocks = []
    for pixels in np.split(page.pixels, page.pixels.shape[2], axis=2) if page.planes else [page.pixels]:
        h, w, s = pixels.shape
        if page.tile:
            t = page.tile
            padded = np.zeros((-(-h // t) * t, -(-w // t) * t, s), pixels.dtype)
            padded[:h, :w] = pixels
            blocks += [padded[y : y + t, x : x + t] for y in range(0, h, t) for x in range(0, w, t)]
        else:
            blocks += [pixels[y : y + page.rows_per_strip] for y in range(0, h, page.rows_per_strip)]
    if page.predictor == 2:
        blocks = [np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1) for b in blocks]
    return [compress(b.astype(b.dtype.newbyteorder("<")).tobytes(), page.compression) for b in blocks]


def write_tiff(pages: list[Page]) -> bytes:
    """A little-endian file with the pages in order."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        h, w, s = page.pixels.shape
        offsets, sizes = [], []
        for block in _blocks(page):
            offsets.append(len(out))
            sizes.append(len(block))
            out += block
        out += b"\0" * (len(out) & 1)
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * page.pixels.itemsize] * s), COMPRESSION: (3, [page.compression]), PHOTOMETRIC: (3, [2 if s >= 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [2 if page.planes else 1]), PREDICTOR: (3, [page.predictor])}
        if page.tile:
            tags |= {TILE_WIDTH: (4, [page.tile]), TILE_HEIGHT: (4, [page.tile]), TILE_OFFSETS: (4, offsets), TILE_SIZES: (4, sizes)}
        else:
            tags |= {ROWS_PER_STRIP: (4, [page.rows_per_strip]), STRIP_OFFSETS: (4, offsets), STRIP_SIZES: (4, sizes)}
        at = {}
        for tag, (kind, values) in tags.items():
            data = struct.pack(f"<{len(values)}{FORMATS[kind]}", *values)
            if len(data) > 4:
                at[tag] = len(out)
                out += data + b"\0" * (len(data) & 1)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, (kind, values) in sorted(tags.items()):
            data = struct.pack("<I", at[tag]) if tag in at else struct.pack(f"<{len(values)}{FORMATS[kind]}", *values).ljust(4, b"\0")
            out += struct.pack("<HHI", tag, kind, len(values)) + data
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in FORMATS:
            continue
        form = f"{order}{count}{FORMATS[kind]}"
        size = struct.calcsize(form)
        where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if where + size > len(data):
            raise BadTiff("a tag's values lie outside the file")
        tags[tag] = list(struct.unpack_from(form, data, where))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, tags: dict[int, list[int]], most: int, order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    kind, predictor = one(COMPRESSION, RAW), one(PREDICTOR, 1)
    bits, planes = set(tags.get(BITS, [1])), one(PLANAR, 1) == 2
    if not w or not h or not s or bits not in ({8}, {16}) or one(PLANAR, 1) not in (1, 2) or predictor not in (1, 2):
        raise BadTiff("no image of 8- or 16-bit samples")
    kept = np.dtype(np.uint8 if bits == {8} else np.uint16)
    held, copies = (1, s) if planes else (s, 1)
    if w * h * s > most:
        raise BadTiff("image too large")
    tw, th = one(TILE_WIDTH), one(TILE_HEIGHT)
    tiled = bool(tw and th)
    bw, bh = (tw, th) if tiled else (w, min(one(ROWS_PER_STRIP, h), h) or h)
    if bw * bh * s > most:
        raise BadTiff("block too large")
    offsets, sizes = (tags.get(TILE_OFFSETS, []), tags.get(TILE_SIZES, [])) if tiled else (tags.get(STRIP_OFFSETS, []), tags.get(STRIP_SIZES, []))
    down, across = -(-h // bh), -(-w // bw)
    if min(len(offsets), len(sizes)) < down * across * copies:
        raise BadTiff("too few strips or tiles")
    pixels = np.empty((h, w, s), kept)
    for k in range(down * across * copies):
        plane, place = divmod(k, down * across)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(decompress(data[offsets[k] : offsets[k] + sizes[k]], kind, rows * bw * held * kept.itemsize), kept.newbyteorder(order)).reshape(rows, bw, held)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kept)
        pixels[y : y + bh, x : x + bw, plane : plane + held] = block[: h - y, : w - x]
    return Page(pixels, kind, predictor, tw if tiled else 0, bh, planes)


def read_tiff(data: bytes, most: int = 1 << 28) -> Iterator[Page]:
    """The pages in order. :class:`BadTiff` for what can't be read, for a loop of directories, and beyond ``most`` samples a page."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise BadTiff("directories form a loop")
        seen.add(at)
        try:
            tags, following = _directory(data, at, order)
        except struct.error:
            raise BadTiff("a directory lies outside the file") from None
        yield _page(data, tags, most, order)
        at = following


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", most: int = 1 << 28) -> DataFrame:
    """One row per page of each file: id and the columns of ``PAGE_SCHEMA``.

    What can't be read gives one row with ``error`` set and the page's other columns null, after the pages before it.
    Pixels are rows of samples, 16-bit ones with the least byte first. A null file gives no row; an empty one an error. Repeated rows and null ids pass through; other columns are not read.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
        one = lambda row: pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names)
        for b in batches:
            types[0] = b.schema.field(0).type
            for key, media in zip(b.column(0).to_pylist(), b.column(1)):
                if not media.is_valid:
                    continue
                n = 0
                try:
                    for n, p in enumerate(read_tiff(media.as_py(), most), 1):  # one page is held at a time
                        h, w, s = p.pixels.shape
                        yield one((key, n - 1, w, h, s, 8 * p.pixels.itemsize, NAMES[p.compression], p.predictor, bool(p.tile), p.pixels.tobytes(), None))
                except BadTiff as e:
                    yield one((key, n, None, None, None, None, None, None, None, None, str(e)))

    return df.select(id_col, media_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, {PAGE_SCHEMA}")


PAGE_WIDTH, PAGE_ROWS, TILE = 64, 512, 64


def bytes_to_tiff(payload: bytes) -> bytes:
    """A payload of 64 n bytes as pages of 64 samples by at most 512 rows.

    By a hash of the payload and the page's number a quarter of the pages is LZW, a quarter PackBits and half deflate;
    independently of that half of them is predicted, and half of them tiled. Equal payloads give equal files.
    """
    rows = len(payload) // PAGE_WIDTH
    image = np.frombuffer(payload, np.uint8).reshape(rows, PAGE_WIDTH, 1)
    seed, pages = zlib.crc32(payload), []
    for k, y in enumerate(range(0, rows, PAGE_ROWS)):
        turn = zlib.crc32(struct.pack("<II", seed, k))
        pages.append(Page(image[y : y + PAGE_ROWS], (LZW, PACKBITS, DEFLATE, DEFLATE)[turn & 3], 1 + (turn >> 2 & 1), TILE * (turn >> 3 & 1)))
    return write_tiff(pages)


def payload_features(counts: np.ndarray) -> str:
    """Mean, standard deviation and entropy in bits of the samples, from their histogram."""
    p = counts / counts.sum()
    values = np.arange(256)
    mean = float(p @ values)
    sd = float(np.sqrt(max(0.0, p @ (values - mean) ** 2)))
    q = p[p > 0]
    return f"mean={mean:.4f};sd={sd:.4f};entropy={float(-(q * np.log2(q)).sum()):.4f}"


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a TIFF file; read it back.

    One row per input row: id, n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back),
    media_bytes, media_sha256, feature, n_pages. Null counts as empty (64 zero bytes); repeated rows and null ids pass
    through; other columns are not read; an empty table gives an empty result. One file is held at a time.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                media = bytes_to_tiff(data + b"\0" * (-len(data) % 64 if data else 64))
                whole, counts, tail, size, n = hashlib.sha256(), np.zeros(256, np.int64), b"", 0, 0
                for page in read_tiff(media):
                    part = page.pixels.tobytes()
                    whole.update(part)
                    counts += np.bincount(page.pixels.reshape(-1), minlength=256)
                    tail, size, n = part[-64:], size + len(part), n + 1
                rows.append((key, len(data), size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), payload_features(counts), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t or b.schema.field(0).type) for c, t in zip(zip(*rows), types)], names)

    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long")
