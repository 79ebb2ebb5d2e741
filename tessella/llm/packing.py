"""Sum-of-squares packing of token documents into fixed windows.

Documents are cut at whole windows; what remains of each is placed, as it comes, at the fill level that minimises the
sum of squared counts of partially filled windows, kept in an array by level. When a task's rows end (or too many
windows are open) the open windows are topped up with pieces cut from the emptiest ones; the very last window is cut
into sequences whose lengths are powers of two. No padding is left.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.llm.bpe import byte_chars
from tessella.llm.common import tidy
from tessella.shipping import ship

#: The pattern by which byte-level vocabularies of this family split text; a fixed value of the file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The white space of that pattern. A run of very many is cut out, as the pattern's engine recurses along it.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MOST_BLANKS = 100_000
LONG_RUN = re.compile(f"[{BLANKS}]{{{MOST_BLANKS},}}")
ID_BYTES = 4


class ByteTokens:
    """Ids of a byte-level vocabulary file as packed little-endian unsigned 32-bit values."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["model"]["end_of_word_suffix"]:
            raise ValueError(f"{path}: another kind of vocabulary")
        byte = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        if len(text) <= MOST_BLANKS:
            return array("I", self.coder.encode_ordinary(text)).tobytes()
        out, at = array("I"), 0
        for run in LONG_RUN.finditer(text):
            # A run is one piece, less its last character where another character follows it.
            end = run.end() - (run.end() < len(text))
            out.extend(self.coder.encode_ordinary(text[at : run.start()]))
            out.extend(self.coder._encode_single_piece(text[run.start() : end]))
            at = end
        out.extend(self.coder.encode_ordinary(text[at:]))
        return out.tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text; the strings of added tokens stand for those tokens."""
        if not text:
            return b""
        if "<" not in text:
            return self._plain(text)
        parts = self.special_pattern.split(text)
        return b"".join([array("I", [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts) if p])


_loaded: dict[str, ByteTokens] = {}


def load(path: str) -> ByteTokens:
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]


class Packer:
    """Online packer of one task. Pieces are (row, start, ids as bytes); ``out`` gets finished sequences."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.counts = np.zeros(capacity + 1, dtype=np.int64)  # open windows by fill level; none at 0 and capacity
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def level(self, size: int) -> int:
        """The level (0: a new window) at which a piece of ``size`` leaves the least sum of squares; ties: the fullest."""
        last = self.capacity - size
        best, cost = 0, int(self.counts[size]) * 2 + 1 if size < self.capacity else 0
        if last >= 1:
            here = self.counts[1 : last + 1]
            change = np.where(here > 0, 2 * (self.counts[1 + size : self.capacity + 1] - here) + 2, np.iinfo(np.int64).max)
            if here[-1] > 0:
                change[-1] = 1 - 2 * here[-1]  # a full window is no longer counted
            k = last - 1 - int(np.argmin(change[::-1]))
            if change[k] <= cost:
                best = k + 1
        return best

    def add(self, row, ids: bytes, total: int) -> None:
        step = self.capacity * ID_BYTES
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            self.close([(row, at // ID_BYTES, ids[at : at + step], total)])
        if rest := ids[whole:]:
            self.place((row, whole // ID_BYTES, rest, total))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // ID_BYTES
        at = self.level(size)
        window = []
        if at:
            window = self.open[at].pop()
            self.counts[at] -= 1
            self.n_open -= 1
        window.append(piece)
        if at + size == self.capacity:
            self.close(window)
            return
        self.open.setdefault(at + size, []).append(window)
        self.counts[at + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.place_again(self.top_up())

    def place_again(self, window: list[tuple]) -> None:
        for piece in window:
            self.place(piece)

    def top_up(self) -> list[tuple]:
        """Fill the fullest open windows with pieces cut from the emptiest; returns the one that stays partial."""
        windows = [w for fill in sorted(self.open) for w in self.open[fill]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        low = 0
        while low < len(windows) - 1:
            window = windows.pop()
            room = self.capacity - sum(len(p[2]) for p in window) // ID_BYTES
            while room and low < len(windows):
                row, start, ids, total = windows[low].pop()
                take = min(room, len(ids) // ID_BYTES)
                cut = len(ids) - take * ID_BYTES
                window.append((row, start + cut // ID_BYTES, ids[cut:], total))
                room -= take
                if cut:
                    windows[low].append((row, start, ids[:cut], total))
                if not windows[low]:
                    low += 1
            if room:
                return window
            self.close(window)
        return windows[low] if low < len(windows) else []

    def finish(self) -> None:
        rest = self.top_up()
        while rest:
            total = sum(len(p[2]) for p in rest) // ID_BYTES
            room, window = 1 << (total.bit_length() - 1), []
            while room:
                row, start, ids, n = rest.pop()
                take = min(room, len(ids) // ID_BYTES)
                window.append((row, start, ids[: take * ID_BYTES], n))
                if ids := ids[take * ID_BYTES :]:
                    rest.append((row, start + take, ids, n))
                room -= take
            self.close(window)

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for row, start, ids, total in window:
            length = len(ids) // ID_BYTES
            self.out.append((row, start, length, zlib.crc32(ids), total, self.next_id, offset))
            offset += length
        self.next_id += 1


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, most_open: int = 4096) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and then ``end_id``; null and empty texts are that id alone. Each id lies in
    exactly one piece. Sequences hold ``capacity`` ids, but for at most log2(capacity) of each task whose lengths are
    powers of two. Repeated rows are packed each, null ids pass through, other columns are not read, and an empty table
    gives no piece. A task packs its own input partition, without a shuffle; at most ``most_open`` windows are held.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = load(path), array("I", [end_id]).tobytes()
        context = TaskContext.get()
        packer = Packer(capacity, most_open, (context.partitionId() if context else 0) << 36)
        id_type = None

        def drained() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [()] * len(names)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for b in batches:
            id_type = b.schema.field(0).type
            for row, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = tokens.packed(t.as_py()) + end
                packer.add(row, ids, len(ids) // ID_BYTES)
            yield drained()
        packer.finish()
        if packer.out:
            yield drained()

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
