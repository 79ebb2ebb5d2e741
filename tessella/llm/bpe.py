"""Byte-pair encoding and decoding with a public vocabulary file whose words end in a suffix.

A word's bytes form a doubly linked list of symbols; a priority queue holds the ranks of all adjacent pairs. The least
rank is merged first, leftmost first among equals; entries whose symbols have changed meanwhile are stale and skipped.
Decoding concatenates vocabulary strings. Normalisation, splitting and added tokens follow the vocabulary file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import tidy
from tessella.shipping import ship

#: Characters that Python's split() takes as white space and the file's patterns don't.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Entries of each generation of a cache, and the longest key that is kept.
CACHE_LIMIT, CACHE_KEY = 150_000, 48


class Recent(dict):
    """A map that makes missing values itself and forgets those not used for a while: memory is bounded."""

    def __init__(self, make: Callable, limit: int = CACHE_LIMIT, longest: int = CACHE_KEY):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splitter, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or not suffix or splitter["behavior"] != "Removed" or not splitter["invert"] or level["add_prefix_space"] or level["use_regex"] or spec["decoder"] or any(x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: another kind of vocabulary")
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(splitter["pattern"]["Regex"])
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.left, self.right, self.merged, self.rank = [], [], [], {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.merged.append(vocab[a + b])
            self.rank[vocab[a] << 32 | vocab[b]] = k
        self.pieces = Recent(self._piece)
        self.chunks = Recent(self._chunk, 250_000)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece of normalised text."""
        data = piece.encode("utf-8")
        n = len(data)
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [k << 32 | i for i in range(n - 1) if (k := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            k, i = top >> 32, top & 0xFFFFFFFF
            j = following[i]
            if symbols[i] != left[k] or j >= n or symbols[j] != right[k]:
                continue  # stale
            symbols[i], symbols[j] = merged[k], -1
            after = following[i] = following[j]
            if after < n:
                previous[after] = i
                if (k := rank.get(symbols[i] << 32 | symbols[after])) is not None:
                    heapq.heappush(queue, k << 32 | i)
            before = previous[i]
            if before >= 0 and (k := rank.get(symbols[before] << 32 | symbols[i])) is not None:
                heapq.heappush(queue, k << 32 | before)
        return [s for s in symbols if s >= 0]

    def _split_chunk(self, chunk: str) -> list[str]:
        """The pieces of text without white space, normalised."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # capital sigma has no word-final form here
        norm = chunk.lower()
        word = norm.rstrip(".,")
        if word.isalpha():
            return [word, norm[len(word) :]] if len(word) < len(norm) else [word]
        return self.pattern.findall(norm)

    def _piece(self, piece: str) -> tuple[str, str]:
        """A piece's ids in decimal, and what they decode to."""
        ids = self.merge(piece)
        return " ".join(map(str, ids)), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        pieces = self._split_chunk(chunk)
        if len(pieces) == 1:
            return self.pieces[pieces[0]]
        found = [self.pieces[p] for p in pieces]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is an added token)"""
        if self.added_pattern is None or "<" not in text and not any(a in text for a in self.added):
            yield text, False
            return
        for k, part in enumerate(self.added_pattern.split(text)):
            if part:
                yield part, k % 2 == 1

    @staticmethod
    def _split(text: str) -> list[str]:
        return [x for x in SPACES.split(text) if x] if NOT_SPACE.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part, is_added in self._parts(text or ""):
            if is_added:
                out.append(self.added[part])
            else:
                for chunk in self._split(part):
                    for piece in self._split_chunk(chunk):
                        out += self.merge(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined by spaces, as a file without a decoder is read; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def round_trip(self, text: str | None) -> tuple[str, str]:
        """The decimal ids joined by spaces, and what they decode to; chunk by chunk, each chunk's result remembered."""
        ids, words = [], []
        for part, is_added in self._parts(text or ""):
            if is_added:
                ids.append(str(self.added[part]))
                words.append(part)
            else:
                for i, w in map(self.chunks.__getitem__, self._split(part)):
                    ids.append(i)
                    words.append(w)
        return " ".join(ids), " ".join(words)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One codec per worker process and file, with its caches."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col`` (array of int): the ids of each whole text. Null and empty texts get an empty array."""
    ship(df.sparkSession)
    return _with_column(df, out_col, "array<int>", text_col, pa.list_(pa.int32()), lambda: load(path).encode)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col`` (string): the decoded ids. Null ids count as none."""
    ship(df.sparkSession)
    return _with_column(df, out_col, "string", ids_col, pa.string(), lambda: lambda ids: load(path).decode(ids or []))


def _with_column(df: DataFrame, out_col: str, sql_type: str, in_col: str, arrow_type: pa.DataType, make: Callable) -> DataFrame:
    if out_col in df.columns:
        raise ValueError(f"column {out_col} exists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            made = pa.array([f(x) for x in b.column(in_col).to_pylist()], arrow_type)
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, out_col])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(out_col, T._parse_datatype_string(sql_type))]))


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded whole text.

    Null and empty texts have no tokens and the digests of the empty string. Repeated rows and null ids pass through;
    other columns are not read; an empty table gives an empty result. Texts are held one Arrow batch at a time.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for b in batches:
            n, ids_sha, words_sha = [], [], []
            for t in b.column(1):
                ids, words = codec.round_trip(t.as_py())
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                words_sha.append(hashlib.sha256(words.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(words_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
