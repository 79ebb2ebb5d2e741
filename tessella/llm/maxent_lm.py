"""A hashed maximum-entropy language model with class-factored softmax, trained by distributed gradient updates.

P(word | history) = P(class | history) P(word | class, history). Both factors are softmaxes over hashed n-gram and skip
features. The class is predicted from the three classes before it. The word in its class is predicted from the words
before it: its weight is its count times exp of the sum of two hashed weights, one for (word before, class, word) and one
for (word before that, class, word), where a word's side of the pair is hashed to one of GROUPS. Its normaliser is a sum
over groups, whatever the size of the vocabulary. Words unseen in training get the Good-Turing mass as one type. Classes are
topics and count bands of words, and frequent words, all from counts over all training texts.

Texts are cut into blocks; a block's distinct words meet their corpus counts bucket by bucket (of word hashes), so that
no task and no driver ever holds the corpus's vocabulary. Training works on counts of class 4-grams, a sufficient
statistic over all training tokens: each update sums the partitions' gradients.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import clearing, crc_of_id, drop_path, saved, scratch, tidy
from tessella.llm.near_dedup import hash_words
from tessella.shipping import ship

TOPICS, BANDS, CLASSES = 6, 4, 64
END_CLASS = CLASSES - 1
FREQUENT = CLASSES - 1 - TOPICS * BANDS
#: Seed words of topics (below 256: a byte tells them apart); length of topics' vectors; texts whose vectors are held at once.
SEED_WORDS, SCALE, STRETCH = 192, 4096, 4096
END = b"\n"  # no word holds a line feed
HASHED = 1 << 14
#: Features of a history (a, b, c): last class, the one before, the third; the last two; the last and the third; none.
N_FEATURES = 6
BLOCK_BYTES = 16 << 20
PARTS = 8
#: Hashed words of a class; features of the word factor; tokens a row of its tables; least and most rows of a table.
GROUPS, WORD_FEATURES, TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS = 16, 2, 256, 1 << 11, 1 << 19
SHARDS = 16
#: How many expected counts a weight of the word factor must outweigh.
PRIOR = 2.0


def words_of(data: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (both exactly what ``bytes`` methods do)."""
    return data.lower().split()


END_HASH = np.uint64(0x5851F42D4C957F2D)

TOKENS_SCHEMA = "block long, ids array<{id}>, held array<boolean>, lengths binary, tokens binary, hashes binary, holding binary"


def _tokenised(docs: DataFrame) -> DataFrame:
    """Blocks of texts: ids and which are held out, numbers of tokens, tokens as ids local to the block (END: 0), and by
    local id the words' hashes and in how many training texts they are."""
    id_sql = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        id_type = None
        keys, held_out, arrays, size = [], [], [], 0
        local: dict[bytes, int] = defaultdict(count().__next__)
        local[END]

        def settle() -> pa.RecordBatch:
            words = list(local)[1:]
            hashes = np.concatenate([[END_HASH], hash_words(np.frombuffer(b" ".join(words), np.uint8)) if words else np.empty(0, np.uint64)])
            lengths = np.array([len(a) for a in arrays])
            tokens = np.concatenate(arrays)
            pairs = (np.repeat(np.arange(len(arrays)) * len(hashes), lengths) + tokens)[~np.repeat(held_out, lengths)]
            pairs.sort()
            holding = np.bincount(pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] % len(hashes), minlength=len(hashes))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (lengths, tokens, hashes, holding)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([keys], pa.list_(id_type)), pa.array([held_out], pa.list_(pa.bool_())), *blobs], ["block", "ids", "held", "lengths", "tokens", "hashes", "holding"])

        for b in batches:
            id_type = b.schema.field(0).type
            for key, held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = t.as_buffer().to_pybytes()
                keys.append(key)
                held_out.append(held)
                arrays.append(np.append(np.fromiter(map(local.__getitem__, words_of(data)), np.uint32), np.uint32(0)))
                size += len(data) + 64
                if size >= BLOCK_BYTES:
                    yield settle()
                    keys, held_out, arrays, size, block = [], [], [], 0, block + 1
                    local.clear()
                    local = defaultdict(count().__next__)
                    local[END]
        if keys:
            yield settle()

    return docs.mapInArrow(tidy(run), TOKENS_SCHEMA.format(id=id_sql))


def _arrays(row: tuple[pa.Scalar, ...], *types: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), t) for x, t in zip(row, types)]


def rounded(x: np.ndarray) -> np.ndarray:
    """Vectors at the length SCALE in whole numbers: their products and sums are exact, whatever the order of rows."""
    return np.rint(SCALE * x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))


@dataclass
class Seeds:
    """Topics of documents: hashes of the words that most training texts hold, and a vector over them per topic."""

    hashes: np.ndarray
    centres: np.ndarray

    @classmethod
    def of(cls, tokens: DataFrame, updates: int = 12) -> Seeds:
        """Topics of all training texts: spherical k-means, whose sums over all texts are the driver's only rows.

        It starts from the seed words whose company (the sum of the vectors of the texts that hold them) differs most, and
        ends after ``updates`` or when nothing changes.
        """

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in zip(*b.columns):
                    hashes, n = _arrays(row, np.int64, np.int64)
                    some = np.flatnonzero(n[1:]) + 1  # END is no word
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(n[some])], ["w", "n"])

        counts = tokens.select("hashes", "holding").mapInArrow(tidy(spread), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
        found = cls(np.array([r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(SEED_WORDS).collect()], np.int64).view(np.uint64), np.zeros((TOPICS, 0)))
        k = len(found.hashes)
        found.centres = np.zeros((TOPICS, k))
        if not k:
            return found

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for held, *row in zip(*b.columns):
                    lengths, ids, hashes = _arrays(row, np.int64, np.uint32, np.uint64)
                    train = ~np.array(held.as_py())
                    for first, n in found.counts(ids, lengths, found.places(hashes)):
                        n = n[train[first : first + len(n)] & n.any(axis=1)]
                        row_, place = np.nonzero(n)
                        blobs = np.bincount(row_, minlength=len(n)).astype(np.uint8), place.astype(np.uint8), n[row_, place].astype(np.uint32)
                        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["sizes", "places", "counts"])

        schema = "sizes binary, places binary, counts binary"
        saved_vectors = saved(tokens.select("held", "lengths", "tokens", "hashes").mapInArrow(tidy(vectors), schema), "lm-vectors")

        def added(of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
            """The sum of ``of`` over all texts' vectors."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(shape, np.int64)
                for b in batches:
                    for sizes, places, n in zip(*(c.to_pylist() for c in b.columns)):
                        sizes = np.frombuffer(sizes, np.uint8)
                        x = np.zeros((len(sizes), k))
                        x[np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(places, np.uint8)] = np.sqrt(np.frombuffer(n, np.uint32))
                        total += of(rounded(x)).astype(np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], ["i", "n"])

            out = np.zeros(shape)
            sums = saved_vectors.mapInArrow(tidy(run), "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
            for r in sums.collect():
                out.ravel()[r["i"]] = r["n"]
            return out

        company = rounded(added(lambda x: x.T @ x, (k, k)))
        first = [0]
        while len(first) < TOPICS:  # furthest first
            first.append(int((company[first] @ company.T).max(axis=0).argmin()))
        found.centres = company[first]
        for _ in range(updates):
            centres = found.centres
            total = added(lambda x, c=centres: ((x @ c.T).argmax(axis=1) == np.arange(TOPICS)[:, None]).astype(float) @ x, (TOPICS, k))
            found.centres = np.where(total.any(axis=1, keepdims=True), rounded(total), centres)
            if (found.centres == centres).all():
                break
        return found

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The seed word that each hash is, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        order = np.argsort(self.hashes)
        found = order[np.minimum(np.searchsorted(self.hashes, hashes, sorter=order), len(order) - 1)]
        return np.where(self.hashes[found] == hashes, found, -1)

    def counts(self, ids: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Counts of the seed words in a block's texts, a bounded number of texts at a time, each with the first text's number."""
        k = len(self.hashes)
        ends = np.cumsum(lengths)
        for i in range(0, len(lengths), STRETCH):
            part = lengths[i : i + STRETCH]
            seed = places[ids[ends[i] - lengths[i] : ends[i + len(part) - 1]]]
            owner = np.repeat(np.arange(len(part)), part)
            hit = seed >= 0
            yield i, np.bincount(owner[hit] * k + seed[hit], minlength=len(part) * k).reshape(len(part), k)

    def topics(self, ids: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Topic of each text of a block."""
        return np.concatenate([(rounded(np.sqrt(n)) @ self.centres.T).argmax(axis=1) for _, n in self.counts(ids, lengths, places)])

    def frequent_hashes(self) -> np.ndarray:
        return self.hashes[:FREQUENT]


BLOCK_SCHEMA = "kind int, block long, id {id}, held_out boolean, bucket int, first long, a binary, b binary, c binary"
BLOCK_NAMES = ["kind", "block", "id", "held_out", "bucket", "first", "a", "b", "c"]


def _blocks(tokens: DataFrame, seeds: Seeds, buckets: int) -> DataFrame:
    """Kind 0: a document's tokens as ids local to its block (a). Kind 1: a block's words of one bucket: first local id,
    hashes (a), counts in training documents (b), topics (c). Local ids are numbered bucket by bucket."""
    id_sql = tokens.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [pa.int32(), pa.int64(), b.schema.field(1).type.value_type, pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            for block, keys, held_out, *row in zip(*b.columns):
                block, keys, held_out = block.as_py(), keys.as_py(), held_out.as_py()
                lengths, ids, hashes = _arrays(row, np.int64, np.uint32, np.uint64)
                topic = seeds.topics(ids, lengths, seeds.places(hashes))
                bucket = (hashes >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                renamed = np.empty(len(hashes), np.uint32)
                renamed[order] = np.arange(len(hashes), dtype=np.uint32)
                ids = renamed[ids]
                hashes, bucket = hashes[order], bucket[order]
                starts = np.cumsum(lengths) - lengths
                train = ~np.repeat(held_out, lengths)
                votes = np.bincount(ids[train].astype(np.int64) * TOPICS + np.repeat(topic, lengths)[train], minlength=len(hashes) * TOPICS).reshape(-1, TOPICS)
                counts = votes.sum(axis=1).astype(np.uint32)
                liked = votes.argmax(axis=1).astype(np.uint8)
                out = [(0, block, key, held, None, None, ids[s : s + n].tobytes(), None, None) for key, held, s, n in zip(keys, held_out, starts, lengths)]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                out += [(1, block, None, None, int(bucket[i]), int(i), hashes[i:j].tobytes(), counts[i:j].tobytes(), liked[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], BLOCK_NAMES)

    return tokens.select("block", "ids", "held", "lengths", "tokens", "hashes").mapInArrow(tidy(run), BLOCK_SCHEMA.format(id=id_sql))


COUNTED_SCHEMA = "block long, first long, counts binary, classes binary, keys binary"


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The 16 bits of each word's hash by which it enters features."""
    return (hashes >> np.uint64(44)).astype(np.uint16)


def groups_of(keys: np.ndarray) -> np.ndarray:
    return (keys & (GROUPS - 1)).astype(np.int64)


def _counted(words: DataFrame, seeds: Seeds) -> DataFrame:
    """Per bucket: every block's words with corpus counts and classes; and one row (block -1) of the bucket's totals."""
    frequent = seeds.frequent_hashes()

    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("block", "first", "a", "b", "c"))))
        hashes = np.frombuffer(b"".join(r[2] for r in rows), np.uint64)
        counts = np.frombuffer(b"".join(r[3] for r in rows), np.uint32)
        topics = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        unique, where = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, where, counts.astype(np.int64))
        votes = np.bincount(where * TOPICS + topics, weights=counts, minlength=len(unique) * TOPICS).reshape(-1, TOPICS)
        kind = (votes.argmax(axis=1) * BANDS + np.digitize(total, [2, 8, 128])).astype(np.uint8)
        for k, h in enumerate(frequent):
            kind[unique == h] = TOPICS * BANDS + k
        kind[unique == END_HASH] = END_CLASS
        per_group = np.bincount(kind.astype(np.int64) * GROUPS + groups_of(keys_of(unique)), weights=total, minlength=CLASSES * GROUPS).astype(np.int64)
        totals = np.append(per_group, [(total > 0).sum(), (total == 1).sum()]).astype(np.int64)
        sizes = np.cumsum([0] + [len(r[4]) for r in rows])
        spread, kinds = total[where], kind[where]
        keys = keys_of(hashes)
        out = [(r[0], r[1], spread[i:j].tobytes(), kinds[i:j].tobytes(), keys[i:j].tobytes()) for r, i, j in zip(rows, sizes, sizes[1:])]
        out.append((-1, 0, totals.tobytes(), b"", b""))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "first", "counts", "classes", "keys"])

    return words.groupBy("bucket").applyInArrow(run, COUNTED_SCHEMA)


@dataclass
class Totals:
    """Sums over all training tokens."""

    per_group: np.ndarray  # (CLASSES, GROUPS)
    types: int
    singles: int

    @property
    def per_class(self) -> np.ndarray:
        return self.per_group.sum(axis=1)

    @property
    def tokens(self) -> int:
        return int(self.per_class.sum())

    @property
    def unseen(self) -> float:
        """Good-Turing mass of unseen words; all of it when there is nothing to learn from."""
        return min(0.5, max(self.singles, 0.5) / self.tokens) if self.tokens else 1.0

    def base(self) -> tuple[float, float]:
        return 0.5, self.tokens + 0.5 * (self.types + 1)


def _totals(counted: DataFrame) -> Totals:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * GROUPS + 2, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["i", "n"])

    found = {r["i"]: r["n"] for r in counted.where("block = -1").select("counts").mapInArrow(tidy(run), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n = np.array([found.get(i, 0) for i in range(CLASSES * GROUPS + 2)], np.int64)
    return Totals(n[:-2].reshape(CLASSES, GROUPS), int(n[-2]), int(n[-1]))


def histories(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of the three classes before each token, last one first; before a document stand end classes."""
    n = len(classes)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    code = np.zeros(n, np.int64)
    for k in (1, 2, 3):
        before = np.full(n, END_CLASS, np.int64)
        before[k:] = classes[:-k] if n > k else []
        before[place < k] = END_CLASS
        code = code * CLASSES + before
    return code


def features(code: np.ndarray) -> np.ndarray:
    """(histories, N_FEATURES) rows of the weight table."""
    a, b, c = code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES
    none = np.zeros_like(code)
    raw = np.stack([none, 1 + a, 1000 + b, 2000 + c, 10_000 + a * CLASSES + b, 20_000 + a * CLASSES + c], axis=1).astype(np.uint64)
    mixed = raw * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) & (HASHED - 1)


def log_probs(weights: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(histories, classes) natural logarithms of P(class | history)."""
    f = features(code)
    out = weights[f[:, 0]].astype(np.float64)
    for k in range(1, N_FEATURES):
        out += weights[f[:, k]]
    out -= out.max(axis=1, keepdims=True)
    return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def _measured(blocks: DataFrame, counted: DataFrame, totals: Totals, id_type: str) -> DataFrame:
    """Kind 0: a document's token counts, base score, word shares in their groups, classes (a) and words' keys (b). Kind 1: class 4-gram counts by part."""
    half, whole = totals.base()
    share = np.log10(np.maximum(totals.per_group, 1))
    miss = np.log10(totals.unseen)
    known = np.log10(1 - totals.unseen) if totals.unseen < 1 else 0.0
    columns = ["kind", "id", "held_out", "part", "n_tokens", "n_known", "base_score", "shares", "a", "b"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = sorted(zip(right.column("first").to_pylist(), right.column("counts").to_pylist(), right.column("classes").to_pylist(), right.column("keys").to_pylist()))
        total = np.frombuffer(b"".join(p[1] for p in pieces), np.int64)
        kind = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        keys = np.frombuffer(b"".join(p[3] for p in pieces), np.uint16)
        texts = left.column("a").to_pylist()
        lengths = np.array([len(x) // 4 for x in texts])
        starts = np.cumsum([0, *lengths])[:-1]
        ids = np.frombuffer(b"".join(texts), np.uint32)
        seen = total > 0
        base = np.add.reduceat(np.log10((total + half) / whole)[ids], starts)
        shares = np.add.reduceat(np.where(seen, np.log10(np.maximum(total, 1)) - share[kind, groups_of(keys)] + known, miss)[ids], starts)
        n_known = np.add.reduceat(seen[ids].astype(np.int64), starts)
        # An unseen word has no class: it is passed over, and it predicts like the rarest words of its topic.
        classes = kind[ids]
        coded = np.where(seen[ids], classes, classes | 128).astype(np.uint8)
        entering = np.where(seen, keys, 0).astype(np.uint16)[ids]
        held = left.column("held_out").to_pylist()
        out = [(0, key, h, None, int(n), int(m), float(s), float(w), coded[i : i + n].tobytes(), entering[i : i + n].tobytes()) for key, h, n, m, s, w, i in zip(left.column("id").to_pylist(), held, lengths, n_known, base, shares, starts)]
        train = np.repeat([not h for h in held], lengths)
        grams, n = np.unique((histories(classes, starts) * CLASSES + classes)[train], return_counts=True)
        part = grams // CLASSES % PARTS
        for p in np.unique(part):
            out.append((1, None, None, int(p), None, None, None, None, grams[part == p].astype(np.uint32).tobytes(), n[part == p].astype(np.int64).tobytes()))
        types = [pa.int32(), left.schema.field("id").type, pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], columns)

    texts = blocks.where("kind = 0").select("block", "id", "held_out", "a")
    return texts.groupBy("block").cogroup(counted.where("block >= 0").groupBy("block")).applyInArrow(run, f"kind int, id {id_type}, held_out boolean, part int, n_tokens long, n_known long, base_score double, shares double, a binary, b binary")


def _merged_grams(measured: DataFrame, groups: int) -> DataFrame:
    """One row per part: all its class 4-grams with their counts. Bounded by the number of class 4-grams.

    Tasks' sums are merged in ``groups`` groups first and those then, so that no task reads what all tasks have found.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for part, a, n in zip(*(c.to_pylist() for c in b.columns)):
                grams, counts = np.frombuffer(a, np.uint32), np.frombuffer(n, np.int64)
                held[part] = _summed(np.concatenate([held[part][0], grams]), np.concatenate([held[part][1], counts])) if part in held else (grams, counts)
        for part, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([grams.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "a", "b"])

    def merge(t: pa.Table) -> pa.Table:
        grams, counts = _summed(np.frombuffer(b"".join(t.column("a").to_pylist()), np.uint32), np.frombuffer(b"".join(t.column("b").to_pylist()), np.int64))
        return pa.Table.from_arrays([pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([grams.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "a", "b"])

    schema = "part int, a binary, b binary"
    summed = measured.where("kind = 1").select("part", "a", "b").mapInArrow(tidy(partial), schema)
    dealt = summed.groupBy("part", F.spark_partition_id() % groups).applyInArrow(merge, schema)
    return dealt.groupBy("part").applyInArrow(merge, schema)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(keys, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, where, counts)
    return unique, total


def _by_feature(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out[ranked[first]] += np.add.reduceat(values[order], first, axis=0)


def part_sums(grams: np.ndarray, counts: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """Observed (no weights) or expected counts of (feature row, class) over one part, as a (HASHED, CLASSES) array."""
    codes, owner = np.unique(grams // CLASSES, return_inverse=True)
    out = np.zeros((HASHED, CLASSES), np.float64)
    observed = np.zeros((len(codes), CLASSES))
    observed[owner, grams % CLASSES] = counts
    for k in range(0, len(codes), 16384):  # bounded memory
        c, o = codes[k : k + 16384].astype(np.int64), observed[k : k + 16384]
        value = o if weights is None else np.exp(log_probs(weights, c)) * o.sum(axis=1, keepdims=True)
        f = features(c)
        for j in range(N_FEATURES):
            _by_feature(f[:, j], value, out)
    return out


def _sums(parts: DataFrame, weights: np.ndarray | None) -> np.ndarray:
    """Add up the parts' sums: at most PARTS sparse tables of fixed size go to the driver."""
    shared = parts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = part_sums(np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(n, np.int64), shared.value)
                at = np.flatnonzero(found.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([found[at].astype(np.float32).tobytes()], pa.binary())], ["rows", "sums"])

    total = np.zeros((HASHED, CLASSES))
    for r in parts.select("a", "b").mapInArrow(tidy(run), "rows binary, sums binary").toLocalIterator():
        total[np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["sums"], np.float32).reshape(-1, CLASSES)
    shared.destroy()
    return total


def train(parts: DataFrame, totals: Totals, updates: int = 8) -> np.ndarray:
    """Weights (HASHED, CLASSES): class frequencies first, then ``updates`` gradient steps over all 4-grams.

    A step is the gradient (observed less expected counts) over the counts' mean, per feature and class, divided by the
    number of features of a history.
    """
    weights = np.zeros((HASHED, CLASSES), np.float32)
    if not totals.tokens:
        return weights
    none = features(np.zeros(1, np.int64))[0, 0]
    weights[none] = np.log((totals.per_class + 0.5) / (totals.tokens + 0.5 * CLASSES))
    observed = _sums(parts, None)
    rate = observed[none] / max(1.0, observed[none].sum())
    # Start from the class bigrams, which a count gives exactly.
    codes = np.arange(CLASSES**2, dtype=np.int64) * CLASSES
    pair = features(codes)[:, 4]
    n = observed[pair]
    some = n.sum(axis=1) > 0
    with np.errstate(divide="ignore"):
        start = np.log((n + 2 * rate) / (n.sum(axis=1, keepdims=True) + 2)) - np.log(np.maximum(rate, 1e-12))
    weights[pair[some]] = np.clip(start[some], -12, 12)
    for _ in range(updates):
        expected = _sums(parts, weights)
        weights += ((2.0 / N_FEATURES) * (observed - expected) / (observed + expected + 1.0)).astype(np.float32)
    return weights


@dataclass
class WordTables:
    """Where the rows of the word factor's features lie: each class has a stretch of each table, by its share of tokens.

    A class whose words are all of one group needs no factor: it has no rows.
    """

    per_group: np.ndarray
    rows: int

    def __post_init__(self):
        many = (self.per_group > 0).sum(axis=1) > 1
        tokens = np.where(many, self.per_group.sum(axis=1), 0)
        self.width = np.where(many, np.maximum(1, self.rows * tokens // max(1, int(tokens.sum()))), 0).astype(np.int64)
        self.size = int(self.width.sum())  # of one feature's table
        self.start = np.cumsum(self.width) - self.width
        with np.errstate(divide="ignore"):
            share = np.log(self.per_group / np.maximum(self.per_group.sum(axis=1, keepdims=True), 1))
        self.log_share = np.where(self.per_group > 0, share, -1e4).astype(np.float32)

    @classmethod
    def of(cls, totals: Totals) -> WordTables:
        return cls(totals.per_group, int(min(MOST_ROWS, max(LEAST_ROWS, totals.tokens // TOKENS_PER_ROW))))

    def class_of_row(self) -> np.ndarray:
        return np.tile(np.repeat(np.arange(CLASSES), self.width), WORD_FEATURES)

    def select(self, marks: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch's tokens those that the factor predicts: (places, rows of each feature, groups)."""
        classes = marks & 127
        at = np.flatnonzero((marks < 128) & (self.width[classes] > 0))
        place = at - np.repeat(starts, np.diff(np.append(starts, len(marks))))[at]
        rows = np.empty((WORD_FEATURES, len(at)), np.int64)
        for k in range(WORD_FEATURES):
            before = np.where(place > k, keys[at - k - 1], END_KEY).astype(np.uint64)
            mixed = (before + np.uint64(1 + 65536 * k)) * np.uint64(0x9E3779B97F4A7C15)
            c = classes[at]
            rows[k] = k * self.size + self.start[c] + (mixed >> np.uint64(32)).astype(np.int64) % self.width[c]
        return at, rows, groups_of(keys[at])

    def log_probs(self, theta: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """(tokens, GROUPS) natural logarithms of P(group | class, words before)."""
        out = self.log_share[classes] + theta[rows[0]]
        for k in range(1, WORD_FEATURES):
            out += theta[rows[k]]
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


END_KEY = int(keys_of(np.array([END_HASH]))[0])
CHUNK = 100_000


def stepped(theta: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One update: the gradient (observed less expected counts) over the expected ones, shared among a token's features."""
    return np.clip(theta + np.clip((observed - expected) / (expected + PRIOR) / WORD_FEATURES, -3, 3), -12, 12)


def word_counts(tables: WordTables, theta: np.ndarray | None, texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Observed (no ``theta``) or expected counts of (row, group) over batches of (marks, keys, starts)."""
    out = np.zeros((WORD_FEATURES * tables.size, GROUPS), np.float32)
    for marks, keys, starts in texts:
        at, rows, groups = tables.select(marks, keys, starts)
        for i in range(0, len(at), CHUNK):
            part = rows[:, i : i + CHUNK]
            if theta is None:
                for k in range(WORD_FEATURES):
                    order = np.sort(part[k] * GROUPS + groups[i : i + CHUNK])
                    unique, n = np.unique(order, return_counts=True)
                    out.ravel()[unique] += n
                continue
            p = np.exp(tables.log_probs(theta, part, (marks & 127)[at[i : i + CHUNK]]))
            for k in range(WORD_FEATURES):
                order = np.argsort(part[k], kind="stable")
                ranked = part[k][order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                out[ranked[first]] += np.add.reduceat(p[order], first, axis=0)
    return out


def _batches_of(b: pa.RecordBatch, a: int, k: int, most: int = 1_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of rows of at most ``most`` tokens: (rows, marks, keys, starts) from the columns of classes and keys."""
    marks, keys = b.column(a).to_pylist(), b.column(k).to_pylist()
    first = 0
    while first < b.num_rows:
        last, size = first, 0
        while last < b.num_rows and (last == first or size + len(marks[last]) <= most):
            size += len(marks[last])
            last += 1
        lengths = np.array([len(x) for x in marks[first:last]])
        yield slice(first, last), np.frombuffer(b"".join(marks[first:last]), np.uint8), np.frombuffer(b"".join(keys[first:last]), np.uint16), np.cumsum([0, *lengths])[:-1]
        first = last


def train_words(measured: DataFrame, totals: Totals, tables: WordTables, updates: int) -> np.ndarray:
    """Weights of the word factor, (rows, GROUPS) in half precision.

    Each update is one pass over the training texts. Few, large tasks sum their own counts; these are added up by stretches
    of rows, which are updated where they are; the driver gets the weights alone, of a size that MOST_ROWS bounds.
    """
    theta = np.zeros((WORD_FEATURES * tables.size, GROUPS), np.float16)
    if not tables.size:
        return theta
    spark = measured.sparkSession
    bounds = np.linspace(0, len(theta), SHARDS + 1).astype(int)
    schema, names = "shard int, kind int, blob binary", ["shard", "kind", "blob"]
    tasks = max(spark.sparkContext.defaultParallelism, totals.tokens >> 26)
    texts = measured.where("NOT held_out").select("a", "b").coalesce(tasks)

    def blobs(found: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind], pa.int32()), pa.array([found[i:j].astype(np.float32).tobytes()], pa.binary())], names)

    def counting(shared, kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value = None if shared is None else shared.value
            yield from blobs(word_counts(tables, value, (x[1:] for b in batches for x in _batches_of(b, 0, 1))), kind)

        return texts.mapInArrow(tidy(run), schema)

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32) for x in t.column("blob").to_pylist())
        return pa.Table.from_arrays([pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    observed = saved(counting(None, 0).groupBy("shard").applyInArrow(added, schema), "lm-observed")
    share = np.exp(tables.log_share)

    def updated(shared):
        def run(t: pa.Table) -> pa.Table:
            k = t.column("shard")[0].as_py()
            found = {0: 0, 1: 0}
            for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist()):
                found[kind] = found[kind] + np.frombuffer(blob, np.float32).reshape(-1, GROUPS)
            rows = slice(bounds[k], bounds[k + 1])
            if shared is None:  # all weights are 0: what is expected follows from the rows' sums
                found[1] = found[0].sum(axis=1, keepdims=True) * share[tables.class_of_row()[rows]]
            before = np.zeros_like(found[0]) if shared is None else shared.value[rows].astype(np.float32)
            return pa.Table.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([stepped(before, found[0], found[1]).astype(np.float16).tobytes()], pa.binary())], names)

        return run

    shared = None
    for _ in range(updates):
        both = observed if shared is None else observed.unionByName(counting(shared, 1))
        for r in both.groupBy("shard").applyInArrow(updated(shared), schema).toLocalIterator():
            theta[bounds[r["shard"]] : bounds[r["shard"] + 1]] = np.frombuffer(r["blob"], np.float16).reshape(-1, GROUPS)
        shared = spark.sparkContext.broadcast(theta.copy())
    return theta


def score_language(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", updates: int = 8, word_updates: int = 2) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` is false. Tokens: words between ASCII white space with A-Z lower-cased, then
    one end. ``base_score``: log10 of add-a-half unigrams; ``score``: of this model. Null counts as empty (one end).
    With nothing to learn from both scores are those of a vocabulary of one type. Topics, counts and training cover all
    these rows. Repeated rows and null ids pass through; columns other than these are not read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tokens_at = scratch(spark, "lm-tokens")
    tokenising = _tokenised(base)
    tokenising.write.option("maxRecordsPerFile", 1).parquet(tokens_at)  # no writer or reader holds many blocks at once
    tokens = spark.read.schema(tokenising.schema).parquet(tokens_at)
    with clearing(spark):
        seeds = Seeds.of(tokens)
    buckets = int(min(65536, max(12, size >> 25)))

    at = scratch(spark, "lm-blocks")
    _blocks(tokens, seeds, buckets).write.partitionBy("kind").parquet(at)
    drop_path(spark, tokens_at)
    blocks = spark.read.schema(BLOCK_SCHEMA.format(id=id_type)).parquet(at)
    counted_at = scratch(spark, "lm-counted")
    _counted(blocks.where("kind = 1").select("bucket", "block", "first", "a", "b", "c"), seeds).write.parquet(counted_at)
    counted = spark.read.schema(COUNTED_SCHEMA).parquet(counted_at)
    totals = _totals(counted)
    measured_at = scratch(spark, "lm-measured")
    measuring = _measured(blocks, counted, totals, id_type)
    measuring.write.partitionBy("kind").parquet(measured_at)
    measured = spark.read.schema(measuring.schema).parquet(measured_at)
    drop_path(spark, at)
    drop_path(spark, counted_at)
    parts_at = scratch(spark, "lm-parts")
    groups = max(1, round((size / BLOCK_BYTES) ** 0.5))
    _merged_grams(measured, groups).repartition(PARTS, "part").write.parquet(parts_at)
    weights = train(spark.read.schema("part int, a binary, b binary").parquet(parts_at), totals, updates)
    drop_path(spark, parts_at)
    tables = WordTables.of(totals)
    with clearing(spark):
        theta = train_words(measured.where("kind = 0"), totals, tables, word_updates)
    return _scored(measured.where("kind = 0"), weights, tables, theta, totals, id_type).withColumnRenamed("id", id_col)


def _scored(measured: DataFrame, weights: np.ndarray, tables: WordTables, theta: np.ndarray, totals: Totals, id_type: str) -> DataFrame:
    """Add up both factors' probabilities in sparse batches: each distinct class history of a batch is worked out once."""
    shared = measured.sparkSession.sparkContext.broadcast((weights, theta))
    tokens = totals.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, theta = shared.value
        for b in batches:
            log10 = np.zeros(b.num_rows)
            for rows, marks, keys, starts in _batches_of(b, 5, 7) if tokens else ():
                classes = marks & 127
                codes, owner = np.unique(histories(classes, starts), return_inverse=True)
                value = np.empty(len(classes))
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(0, len(codes) + 16384, 16384))
                for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    table = log_probs(weights, codes[k * 16384 : (k + 1) * 16384])
                    value[order[i:j]] = table[owner[order[i:j]] - k * 16384, classes[order[i:j]]]
                value[marks >= 128] = 0.0
                at, features_, groups = tables.select(marks, keys, starts)
                for i in range(0, len(at), CHUNK):
                    here = at[i : i + CHUNK]
                    found = tables.log_probs(theta, features_[:, i : i + CHUNK], classes[here])
                    value[here] += found[np.arange(len(here)), groups[i : i + CHUNK]]
                log10[rows] = np.add.reduceat(value, starts) / np.log(10)
            score = log10 + np.array(b.column(4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([tokens] * b.num_rows, pa.int64()), b.column(6), pa.array(score, pa.float64())], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return measured.select("id", "held_out", "n_tokens", "n_known", "shares", "a", "base_score", "b").mapInArrow(tidy(run), f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def holds_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(id_col) % 5 == 1
