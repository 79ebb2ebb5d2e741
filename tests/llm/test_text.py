import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, entries, license_scan, packing
from tests.conftest import DATA

PIECES = st.lists(st.sampled_from([*"aAbzéİΣσς'sS12३ \n\t\r\x0b\x1c\x1f\x85\xa0 　!?.,<|>_ß́ẛ̣ǅ漢😀​­", "<|endoftext|>", "<|startoftext|>", "'ll", " the", "tion"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def word():
    path = entries.tokenizer_path("word_bpe_49k.json")
    return bpe.WordBpe(path), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def byte():
    path = entries.tokenizer_path("byte_bpe_50k.json")
    return packing.ByteTokens(path), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_word_bpe_equals_library(word, text):
    mine, library = word
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    assert mine.encode(text) == ids and mine.decode(ids) == decoded
    assert mine.round_trip(text) == (" ".join(map(str, ids)), decoded)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_byte_ids_equal_library(byte, text):
    mine, library = byte
    assert np.frombuffer(mine.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u3000", " \n"])
def test_byte_ids_of_long_blank_runs(byte, blank):
    mine, library = byte
    for n in (packing.MOST_BLANKS - 1, packing.MOST_BLANKS, packing.MOST_BLANKS + 1, 2_000_000):
        run = blank * (n // len(blank))
        for text in (f"a{run}b",) if n > 200_000 else (run, f"a{run}", f"{run}b", f"x {run} 's", f"{run}a{run}<|endoftext|>{run}"):
            ids = mine.packed(text)
            assert len(ids) and np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_word_and_small_caches(word):
    mine, library = word
    text = "ab" * 20000
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids
    cache = bpe.Recent(lambda k: k * 2, limit=3)
    assert [cache[str(i % 7)] for i in range(50)] == [str(i % 7) * 2 for i in range(50)] and len(cache) + len(cache.old) <= 6


def test_bpe_query(spark, word):
    _, library = word
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    for r in entries.op3_bpe(spark, f"{DATA}/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns_on_odd_rows(odd_documents, odd_rows, no_documents):
    path = entries.tokenizer_path("word_bpe_49k.json")
    both = bpe.bpe_decode(bpe.bpe_encode(odd_documents, path), path)
    rows = both.collect()
    assert len(rows) == len(odd_rows) and all(r["ids"] == [] and r["decoded"] == "" for r in rows if not (r["text"] or "").strip())
    assert bpe.bpe_digests(odd_documents, path).count() == len(odd_rows) and bpe.bpe_digests(no_documents, path).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe_encode(odd_documents, path, out_col="kept")


def check_packing(rows, documents, capacity=2048):
    """Every id once, in place; sequences gapless and unpadded."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == set(documents)
    for key, found in pieces.items():
        ids, at = documents[key], 0
        for r in sorted(found, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    odd = Counter()
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity
        odd[at == capacity] += 1
    return odd[False]


def test_packing_query(spark, byte):
    _, library = byte
    documents = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    df = entries.op8_packing(spark, f"{DATA}/sf0.001")
    assert check_packing(df.collect(), documents) <= 11 * max(1, df.rdd.getNumPartitions())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([2, 8, 16, 32]), st.integers(1, 6))
def test_packer_invariants(sizes, capacity, most_open):
    packer = packing.Packer(capacity, most_open, 0)
    documents = {k: list(range(k, k + n)) for k, n in enumerate(sizes)}
    for k, ids in documents.items():
        packer.add(k, np.array(ids, "<u4").tobytes(), len(ids))
        assert packer.n_open <= most_open + 1
    packer.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packing([dict(zip(names, x)) for x in packer.out], documents, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=15, max_size=15), st.integers(1, 15))
def test_level_has_least_sum_of_squares(counts, size):
    packer = packing.Packer(16, 10, 0)
    packer.counts[1:16] = counts

    def cost(h):
        n = packer.counts.copy()
        n[h] -= h > 0
        n[h + size] += 1
        n[0] = n[16] = 0
        return int((n * n).sum())

    allowed = [h for h in range(16) if h + size <= 16 and (h == 0 or packer.counts[h])]
    assert cost(packer.level(size)) == min(map(cost, allowed))


def test_packing_on_odd_rows(odd_documents, odd_rows, no_documents):
    path = entries.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(odd_documents, path).collect()
    assert sum(r["doc_tokens"] == 1 for r in rows) == sum(not t for _, t in odd_rows)
    assert packing.pack(no_documents, path).count() == 0


def plain_dice(unit, threshold=0.8):
    import re

    words = re.sub(r"[\W_]+", " ", unit.lower()).split()
    grams = {f"{a} {b}" for a, b in zip(words, words[1:])}
    found = []
    for name, text in license_scan.TEMPLATES:
        other = set(license_scan.template_bigrams(text))
        dice = 2 * len(grams & other) / max(1, len(grams) + len(other))
        if dice >= threshold:
            found.append((-dice, name))
    return min(found, default=None)


def test_license_scan_equals_plain(spark, odd_documents, odd_rows, no_documents):
    texts = ["Licensed under CC BY-NC 4.0.", "a\n  RELEASED under the MIT licence, the MIT License!\nb", "Released under\nthe MIT License.", "Licensed under the Apache License\nReleased under the MIT License.", "Released under the BSD 3 Clause License", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        t = texts[r["doc_id"]] or ""
        hits = [h for u in [*t.split("\n"), *([t] if "\n" in t else [])] if (h := plain_dice(u))]
        best = min(hits, default=(0, None))
        assert (r["license"], r["n_matches"]) == (best[1], len(hits)) and abs(r["dice"] + best[0]) < 1e-12
        assert r["licenses"] == ",".join(sorted({h[1] for h in hits}))
    out = license_scan.scan_licenses(odd_documents)
    assert out.count() == len(odd_rows) and out.where("license IS NOT NULL").count() == 0
    assert license_scan.scan_licenses(no_documents).count() == 0
    found = entries.op2_license_scan(spark, f"{DATA}/sf0.01").where(F.col("license").isNotNull())
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("text rlike '(?i)licensed under|MIT License'")
    assert found.count() == docs.count()


def test_license_scan_finds_notices_inside_other_text(spark):
    import textwrap

    prose = "\n".join(f"Plain line {k} of a longer document about rivers number {k * 7}." for k in range(40))
    known = license_scan.TEMPLATES + license_scan.FULL_TEXTS
    inside = [(name, f"{prose}\n{text}\n{prose}") for name, notice in known for text in (f"Some words come before. {notice} Others follow it here.", textwrap.fill(notice, 72), textwrap.fill(notice, 30))]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(inside)], "doc_id long, text string")
    found = {r["doc_id"]: (r["license"], r["licenses"]) for r in license_scan.scan_licenses(df).collect()}
    assert found == {k: (name, name) for k, (name, _) in enumerate(inside)}
    assert license_scan.scan_licenses(spark.createDataFrame([(1, prose)], "doc_id long, text string")).where("n_matches > 0").count() == 0
