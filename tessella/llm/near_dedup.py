"""Near-duplicate detection by order min-hashing.

For each of several hash orders the sketch takes the least occurrence-labelled word k-mers of a text and keeps them in
text order, so that it is sensitive to edit similarity; bands of sketches give candidates. Candidates are verified by
the Jaccard coefficient of their shingle sets and by a banded alignment of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import clearing, flagged, saved, text_or_empty, tidy
from tessella.llm.components import connected_components
from tessella.shipping import ship

SHINGLE, SIMILARITY = 5, 0.8
#: Least k-mers per sketch, sketches per band, bands.
LEAST, ROWS, BANDS = 2, 3, 20
#: About so many texts of a group are put in order by one task.
STRETCH = 128
#: Shingles in the prefixes of more texts than this do not pair them directly.
HOT = 32
#: Sets may differ in this share of their sizes' sum.
SPREAD = (1 - SIMILARITY) / (1 + SIMILARITY)
LINKED, UNLIKE, REORDERED = 0, 1, 2

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)
_SEEDS = np.random.default_rng(9).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64)
_PLACES = np.random.default_rng(5).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64(2**64 - 1)
WINDOW = 1 << 20


def norm_words(text: str | Column) -> Column:
    """Lower-case words of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _C2
    x = (x ^ x >> np.uint64(27)) * _C3
    return x ^ x >> np.uint64(31)


def hash_words(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of normalised UTF-8 bytes, in windows that end at a space: memory is bounded."""
    if not len(data):
        return np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            gaps = np.flatnonzero(data[at:end] == 32)
            if not len(gaps):  # a word longer than the window
                gaps = np.flatnonzero(data[at:] == 32)
            end = at + int(gaps[-1] if gaps[-1:] < WINDOW else gaps[0]) if len(gaps) else len(data)
        part = data[at:end]
        gaps = np.flatnonzero(part == 32)
        starts = np.concatenate([[0], gaps + 1])
        sizes = np.diff(np.concatenate([starts, [len(part) + 1]]))
        place = np.arange(len(part)) - np.repeat(starts, sizes)[: len(part)]
        values = (part.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
        values[gaps] = 0
        out.append(_mix(np.add.reduceat(values, starts)))
        at = end + 1
    return np.concatenate(out)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of ``k`` words in text order; a shorter text is one shingle, an empty one none."""
    words = words.astype(np.uint64)
    n = len(words) - k + 1
    if n >= 1:
        return _mix(sum(words[i : i + n] * _PLACES[i] for i in range(k)))
    return _mix(np.array([(words * _PLACES[: len(words)]).sum() + np.uint64(len(words))])) if len(words) else np.empty(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Band keys of a text's shingles."""
    if not len(s):
        return np.empty(0, np.int64)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    index = np.arange(len(s))
    labelled = _mix(ranked + (index - np.maximum.accumulate(np.where(first, index, 0))).astype(np.uint64) * _C1)
    pairs = np.empty(len(_SEEDS), np.uint64)
    step = max(1, min(len(_SEEDS), 2_000_000 // len(s)))
    for k in range(0, len(_SEEDS), step):
        v = (labelled[None, :] ^ _SEEDS[k : k + step, None]) * _C2
        v ^= v >> np.uint64(32)
        v *= _C3
        rows = np.arange(len(v))
        one = v.argmin(axis=1)
        if len(s) == 1:
            pairs[k : k + step] = labelled[one]
            continue
        v[rows, one] = _TOP
        two = v.argmin(axis=1)
        swap = order[one] > order[two]
        a, b = np.where(swap, two, one), np.where(swap, one, two)
        pairs[k : k + step] = labelled[a] * _C1 + labelled[b]
    bands = _mix(pairs).reshape(BANDS, ROWS)
    return _mix((bands * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C1).astype(np.int64)


#: Up to so many edits the furthest-reaching alignment is followed; beyond, the band is filled in row by row.
FEW_EDITS = 48


def _slide(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """From (i, j) along equal words: the row of the first mismatch. Looks ahead in growing steps."""
    last, step = min(len(a) - i, len(b) - j), 8
    at = 0
    while at < last:
        n = min(step, last - at)
        wrong = a[i + at : i + at + n] != b[j + at : j + at + n]
        k = int(wrong.argmax())
        if wrong[k]:
            return i + at + k
        at, step = at + n, min(step * 4, 1 << 16)
    return i + last


def edit_similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / longer length >= ``similarity``, by alignment within the band that this many edits allow.

    Memory is that of a few rows of the band, whatever the texts' length and order.
    """
    n, m = len(a), len(b)
    most = int((1 - similarity) * max(n, m) + 1e-9)
    if abs(n - m) > most:
        return False
    goal, reach = m - n, {0: _slide(a, b, 0, 0)}
    for e in range(min(most, FEW_EDITS) + 1):
        if reach.get(goal, -1) >= n:
            return True
        new = {}
        for k in range(max(-e - 1, -n), min(e + 1, m) + 1):
            i = min(max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1), n, m - k)
            if i >= 0:
                new[k] = _slide(a, b, i, i + k)
        reach = new
    return most > FEW_EDITS and _banded(a, b, most)


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` edits turn a into b: rows of the band |column - row| <= most, each from the one before."""
    n, m, width = len(a), len(b), 2 * most + 1
    far = np.int32(n + m + 1)
    place = np.arange(width, dtype=np.int32)
    row = np.where(place >= most, place - most, far).astype(np.int32)  # row 0: column j costs j
    row[np.arange(width) - most > m] = far
    padded = np.concatenate([np.zeros(most, b.dtype), b, np.zeros(width, b.dtype)])
    for i in range(1, n + 1):
        # Entry d stands for column i + d - most; the diagonal step comes from entry d of the row before, the step down from d + 1.
        step = row + (padded[i - 1 : i - 1 + width] != a[i - 1])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        lo, hi = max(0, most - i), min(width, m - i + most + 1)
        if lo >= hi:
            return False
        step[:lo] = far
        step[hi:] = far
        if i <= most:
            step[lo] = min(step[lo], i)  # column 0
        row = np.minimum.accumulate(step - place) + place
        if i % 64 == 0 and row[lo:hi].min() > most:
            return False
    return bool(row[m - n + most] <= most)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Shingle sets and word order both agree by ``SIMILARITY`` or more. ``a`` and ``b``: word hashes."""
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= SIMILARITY * (len(x) + len(y) - shared) - 1e-9 and edit_similar(a, b)


def _sketched(base: DataFrame) -> DataFrame:
    """id, digest of the normalised text, number of distinct shingles, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = [], []
            for t in b.column(2):
                s = shingles(hash_words(np.frombuffer(t.as_buffer(), np.uint8)))
                sizes.append(len(np.unique(s)))
                keys.append(sketch(s))
            lengths = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))], ["id", "digest", "size", "keys"])

    kind = base.schema["id"].dataType.simpleString()
    texts = base.select("id", norm_words("text").alias("norm")).select("id", F.unhex(F.md5("norm")).alias("digest"), "norm")
    return texts.mapInArrow(tidy(run), f"id {kind}, digest binary, size long, keys array<long>")


def _words(texts: DataFrame) -> DataFrame:
    """(node, norm) to (node, words): four bytes of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(hash_words(np.frombuffer(t.as_buffer(), np.uint8)) >> np.uint64(32)).astype(np.uint32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], ["node", "words"])

    return texts.mapInArrow(tidy(run), "node long, words binary")


def _paired(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) with the words of both as a and b. A text with many partners is dealt out by partner."""
    # v may be a leader of very many u: its words are repeated once per 64 partners.
    salts = saved(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("n_salts")), "near-salts")
    right = salts.join(words.withColumnRenamed("node", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.col("words").alias("b"))
    salted = pairs.join(salts, "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("n_salts")).cast("int")).drop("n_salts")
    left = salted.join(words.select(F.col("node").alias("u"), F.col("words").alias("a")), "u")
    return left.join(right, ["v", "salt"]).select(*pairs.columns, "a", "b")


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _paired(pairs.select("u", "v"), words).mapInArrow(tidy(run), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (least id of its class), n_links, class_size, kept (first of its class), words_md5.

    Texts whose normalised words are equal are one text. Two texts are linked when a band of their sketches agrees and
    both the Jaccard coefficient of their 5-word shingle sets and their word edit similarity are 0.8 or more; classes
    are the connected components. ``n_links`` counts verified links of the row's text to other texts. Within a band's
    group each text is compared to the least one; where texts of a group remain in different classes, also to its
    neighbours in a random order that differs by band, and where they do even then, every pair of different classes is
    verified or proven unlike. Null counts as empty; empty texts are all one class; texts of
    less than five words equal only themselves. Repeated rows of one id share a class and exactly one row of a class is
    kept; null ids count as largest. Columns other than id and text are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    with clearing(docs.sparkSession):
        return _near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col)


def _near_duplicates(base: DataFrame, id_col: str) -> DataFrame:
    rows = saved(_sketched(base).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    nodes = saved(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min_by("id", "row").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys")), "near-nodes")
    band = nodes.select("node", "size", F.explode("keys").alias("key"))
    # Aggregates are written before rows are joined to them: Spark splits a skewed join's hot key only where both sides
    # are plain shuffles, not where one is the aggregate of the other.
    groups = saved(band.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("lead.node").alias("v"), F.col("lead.size").alias("v_size"), "n"), "near-groups")
    grouped = saved(band.join(groups, "key"), "near-grouped")
    words = saved(_node_words(base, nodes, grouped.select("node").distinct()), "near-words")

    alike = F.least("size", "v_size") >= SIMILARITY * F.greatest("size", "v_size") - 1e-9
    led = saved(_verified(saved(grouped.where((F.col("node") != F.col("v")) & alike).select(F.col("node").alias("u"), "v").distinct(), "near-pairs"), words), "near-led")
    links = led
    roots = connected_components(led)
    # Groups that still hold several classes: neighbours in an order of the group's own, if of different classes.
    rooted = grouped.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    beside = saved(_neighbours(rooted.join(saved(mixed, "near-mixed"), "key")), "near-beside")
    more = _verified(beside, words)
    links = saved(led.unionByName(more).distinct(), "near-linked")
    # What is mixed even now is settled exactly: every pair of a group is verified or shares too few shingles.
    rooted = saved(grouped.select("key", "node").join(connected_components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
    mixed = saved(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "near-unsettled")
    few, close = _sharing(_sets(words, rooted.join(mixed, "key").select("node", "root").distinct()))
    measured = saved(_differences(_centred(saved(close, "near-close"), grouped), words), "near-differences")
    near = measured.where(F.col("status") == LINKED).select("u", "v")
    rest = saved(few.unionByName(_unlinked_pairs(measured)).distinct(), "near-rest")
    links = saved(links.unionByName(near).unionByName(_verified(rest, words)).distinct(), "near-links")
    return _classes(rows, nodes, links, id_col)


def _neighbours(rooted: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Pairs of different classes that are next to each other, or next but one, in a random order of their group.

    The order of a group of ``n`` texts is cut into stretches of about ``stretch`` texts, so that no task orders a whole
    group. The first sixteenth of a stretch also ends the stretch before it, which keeps the neighbours at the cuts.
    """
    parts = F.ceil(F.col("n") / stretch)
    place = F.shiftrightunsigned(F.xxhash64("key", "node"), 33) * parts / F.lit(float(1 << 31))
    part = F.floor("place")
    cut = rooted.select("key", "node", "size", "root", place.alias("place")).select("*", F.explode(F.when((F.col("place") - part < 1 / 16) & (part > 0), F.array(part - 1, part)).otherwise(F.array(part))).alias("part"))
    w = Window.partitionBy("key", "part").orderBy("place", "node")
    me = F.struct("node", "size", "root")
    # Dealt out by stretch, as the join before leaves a group in one partition.
    ordered = cut.repartition("key", "part").select("node", "size", "root", F.array(F.lag(me, 1).over(w), F.lag(me, 2).over(w)).alias("other"))
    pairs = ordered.select("node", "size", "root", F.explode(F.filter("other", lambda o: o.isNotNull())).alias("o"))
    alike = F.least("size", "o.size") >= SIMILARITY * F.greatest("size", "o.size") - 1e-9
    return pairs.where((F.col("root") != F.col("o.root")) & alike).select(F.greatest("node", "o.node").alias("u"), F.least("node", "o.node").alias("v")).distinct()


def _sets(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, root) to (node, root, tokens): the distinct shingles that ``similar`` compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(np.frombuffer(w.as_buffer(), np.uint32))).view(np.int64) for w in b.column(2)]
            lengths = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))], ["node", "root", "tokens"])

    return saved(wanted.join(words, "node").select("node", "root", "words").mapInArrow(tidy(run), "node long, root long, tokens array<long>"), "near-sets")


def _sharing(sets: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """All pairs of different roots that may reach ``SIMILARITY``, by the prefix filter; no such pair is left out.

    Shingles are put in one order for all texts: those of a single root first, then rare before common ones. Texts x and
    y of sizes |y| <= |x| can reach the similarity s only if one of the first |x| - s |x| + 1 shingles of x is one of the
    first |y| - 2 s |y| / (1 + s) + 1 shingles of y. A passage that very many texts share is late in the order.

    Gives (u, v) pairs of texts that share a shingle of at most ``hot`` texts; and, of the shingles that more share, their
    texts (u, root, size), under the number of the least of them (v): see :func:`_unlinked_pairs`.
    """
    held = sets.select("node", "root", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    spread = saved(held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("token", "n"), "near-spread")
    ranked = held.join(spread, "token").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    first = F.col("size") - F.size("shared")
    fewer = lambda share: (F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1).cast("int")
    prefix = F.slice("shared", 1, F.greatest(fewer(SIMILARITY) - first, F.lit(0)))
    placed = ranked.select("node", "root", "size", first.alias("first"), F.posexplode(prefix).alias("at", "x"))
    cut = saved(placed.select(F.col("x.token").alias("token"), "node", "root", "size", (F.col("first") + F.col("at") < fewer(2 * SIMILARITY / (1 + SIMILARITY))).alias("early")), "near-prefixes")
    groups = cut.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("early").alias("any"), F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("lo < hi AND any")
    dealt = saved(cut.join(saved(groups.select("token", "n", "least"), "near-tokens"), "token"), "near-dealt")
    probes = dealt.where(F.col("n") <= hot)
    kept = probes.where("early").select("token", F.col("node").alias("o_node"), F.col("root").alias("o_root"), F.col("size").alias("o_size"))
    alike = (F.col("o_size") <= F.col("size")) & (F.col("o_size") >= SIMILARITY * F.col("size") - 1e-9)
    few = probes.join(kept, "token").where((F.col("root") != F.col("o_root")) & alike).select(F.greatest("node", "o_node").alias("u"), F.least("node", "o_node").alias("v")).distinct()
    close = dealt.where(F.col("n") > hot).select(F.col("node").alias("u"), F.col("least").alias("v"), "root", "size").distinct()
    return few, close


def _centred(close: DataFrame, grouped: DataFrame) -> DataFrame:
    """(u, v, root, v_root, size): of the texts around one v, each other one beside the most central of them.

    That is the text whose band keys most texts share: a sketch is mostly common where its text is.
    """
    shared = grouped.groupBy(F.col("node").alias("u")).agg(F.sum("n").alias("score"))
    central = F.max_by(F.struct("u", "root"), F.struct("score", -F.col("u")))
    centres = saved(close.join(shared, "u").groupBy("v").agg(central.alias("q")), "near-centres")
    return saved(close.join(centres, "v").where("u <> q.u").select("u", F.col("q.u").alias("v"), "root", F.col("q.root").alias("v_root"), "size").distinct(), "near-centred")


def _differences(close: DataFrame, words: DataFrame) -> DataFrame:
    """(u, v, root, v_root, size) with the shingles in which u differs from v, and whether they are linked.

    ``status``: LINKED; UNLIKE, as their sets of shingles differ too much; or REORDERED: the sets agree, the order does not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, tokens = [], []
            for x, y in zip(b.column(5), b.column(6)):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                p, q = np.unique(shingles(x)), np.unique(shingles(y))
                tokens.append(np.setxor1d(p, q, assume_unique=True).view(np.int64))
                close = len(tokens[-1]) <= SPREAD * (len(p) + len(q)) + 1e-9
                status.append(UNLIKE if not close else LINKED if edit_similar(x, y) else REORDERED)
            lengths = np.cumsum([0, *map(len, tokens)])
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(status, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))], ["u", "v", "root", "v_root", "size", "status", "tokens"])

    return _paired(close, words).mapInArrow(tidy(run), "u long, v long, root long, v_root long, size int, status int, tokens array<long>")


def _unlinked_pairs(measured: DataFrame) -> DataFrame:
    """Pairs (u, v) around the same text p that may be similar though p does not link them; no such pair is left out.

    With c = (1 - s) / (1 + s), sets x and y reach the similarity s if they differ in at most c (|x| + |y|) shingles. If
    x and y differ from p in the sets X and Y, they differ from each other in |X| + |Y| - 2 |X & Y|. So X and Y must share
    (e(x) + e(y)) / 2 shingles or more, where e(x) = |X| - c |x|. One of the two is unlike p, so its e is at least the least
    e0 of those. Shingles in no other class can't be shared: a text with too few others is out, which rids a family of
    copies with changes of their own of all its pairs. For the rest, rare ones come first, as in :func:`_sharing`.
    Texts that only their order keeps from p are paired with all others around p.
    """
    own = F.when(F.col("status") == LINKED, F.col("v_root")).otherwise(F.col("root"))
    rows = measured.select("v", "u", own.alias("own"), "size", "status", "tokens", (F.size("tokens") - SPREAD * F.col("size")).alias("e"))
    unlike = rows.where(F.col("status") == UNLIKE).groupBy("v").agg(F.min("e").alias("e0"))
    held = rows.where(F.col("status") != REORDERED).join(unlike, "v").select("v", "u", "own", "size", "status", "e", "e0", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    spread = saved(held.groupBy("v", "token").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("v", "token", "n"), "near-differing")
    ranked = saved(held.join(spread, ["v", "token"]).groupBy("v", "u", "own", "size", "status", "e", "e0", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared")), "near-ranked")

    def prefixes(df: DataFrame, needed: Column) -> DataFrame:
        n = (F.size("shared") - F.greatest(F.ceil(needed - 1e-6), F.lit(1)) + 1).cast("int")
        return df.select("v", "u", "own", "size", F.explode(F.slice("shared", 1, F.greatest(n, F.lit(0)))).alias("x")).select("v", F.col("x.token").alias("token"), "u", "own", "size")

    with_unlike = (F.col("e") + F.col("e0")) / 2
    with_linked = F.col("n_tokens") - SPREAD * F.col("size") * (1 + 1 / SIMILARITY)
    far, near = ranked.where(F.col("status") == UNLIKE), ranked.where(F.col("status") == LINKED)
    others = lambda df: df.select("v", "token", F.col("u").alias("o"), F.col("own").alias("o_own"), F.col("size").alias("o_size"))
    alike = (F.col("own") != F.col("o_own")) & (F.least("size", "o_size") >= SIMILARITY * F.greatest("size", "o_size") - 1e-9)
    short = saved(prefixes(far, with_unlike), "near-far")
    found = short.join(others(short), ["v", "token"]).where(alike & (F.col("u") > F.col("o")))
    found = found.unionByName(prefixes(near, with_unlike).join(others(prefixes(far, with_linked)), ["v", "token"]).where(alike))
    turned = rows.where(F.col("status") == REORDERED).select("v", "u", "size", "own").join(rows.select("v", F.col("u").alias("o"), F.col("size").alias("o_size"), F.col("own").alias("o_own")), "v").where(alike)
    pairs = found.select("u", "o").unionByName(turned.select("u", "o"))
    return pairs.select(F.greatest("u", "o").alias("u"), F.least("u", "o").alias("v")).distinct()


def _node_words(base: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the wanted nodes, from a second scan that a bounded filter of their ids thins out."""
    picked = saved(nodes.join(wanted, "node").select("node", "id", "digest"), "near-picked")
    texts = flagged(base, [F.col("id")], picked).where("_maybe").select(norm_words("text").alias("norm")).withColumn("digest", F.unhex(F.md5("norm")))
    return _words(texts.join(picked.select("digest", "node"), "digest").select("node", "norm")).dropDuplicates(["node"])


def _classes(rows: DataFrame, nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    roots = connected_components(links)
    ends = links.select("u").unionAll(links.select(F.col("v").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("digest", "node").join(roots, "node", "left").join(ends.withColumnRenamed("u", "node"), "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = saved(rows.select("id", "row", "digest").join(known, "digest").select("id", "row", "root", "n_links", "digest"), "near-placed", keep=True)
    first = saved(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size")), "near-first", keep=True)
    return placed.join(first, "root").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_links", "class_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("words_md5"))
