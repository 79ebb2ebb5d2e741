import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import entries, exact_dedup, line_dedup, near_dedup
from tessella.llm.common import drawn, filter_bits, in_filter, keep_rows, key_filter, saved, shared_dir
from tessella.llm.components import connected_components
from tests.conftest import DATA, assert_same

NORMAL = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert_same(entries.queries()[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(entries.oracle_sql()[name]))


def test_exact_dedup_on_odd_rows(odd_documents, odd_rows):
    found = exact_dedup.exact_dedup(odd_documents).collect()
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[hashlib.sha256(NORMAL.sub(" ", t or "").encode()).hexdigest()].append(i)
    assert len(found) == len(odd_rows)
    for r in found:
        ids = groups[r["text_sha256"]]
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None) and r["group_size"] == len(ids)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_dedup_of_nothing(no_documents):
    assert exact_dedup.exact_dedup(no_documents).count() == 0


def test_colliding_digests_are_told_apart(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, text string")
    one = F.unhex(F.lit("00"))
    out = base.select("id", F.lit(1).cast("long").alias("keep_id"), F.lit(4).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.unhex(F.sha2("text", 256)).alias("digest"))
    wrong = base.select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    again = {r["id"]: r for r in exact_dedup._by_whole_text(base, out, wrong).collect()}
    assert [(again[i]["keep_id"], again[i]["group_size"], again[i]["kept"]) for i in (1, 2, 3, 4)] == [(1, 2, True), (2, 1, True), (1, 2, False), (4, 1, True)]
    assert one is not None and exact_dedup._unequal(base, base.select("id")) is None


def digest_rows(spark, ids):
    return spark.createDataFrame([(i, f"{i % 5:02x}") for i in ids], "id long, h string").select("id", F.unhex("h").alias("digest"), F.col("id").alias("row"))


def test_index_compacts_by_level_and_looks_up(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    for ids in ([10, 11, 12], [3, 5, 6], [1, 10]):
        index.flush(digest_rows(spark, ids))
    assert [len(level) for level in index.levels] == [1, 1] and all(r.bits for level in index.levels for r in level)
    assert sorted(r["id"] for r in index.unseen(digest_rows(spark, [20, 24, 29, 22, 23])).collect()) == [24, 29]
    found = {bytes(r["digest"])[0]: (r["keep_id"], r["keep_row"], r["n"]) for r in index.compact().collect()}
    assert found == {0: (5, 5, 3), 1: (1, 1, 3), 2: (12, 12, 1), 3: (3, 3, 1)}


def test_exact_dedup_goes_through_filters_and_runs(spark, odd_documents, odd_rows, monkeypatch):
    """Without the lookup in other runs' filters, copies in different memtables would be missed."""
    want = sorted((str(r["doc_id"]), r["group_size"]) for r in exact_dedup.exact_dedup(odd_documents).collect())
    monkeypatch.setattr(exact_dedup.DigestIndex, "maybe_in", lambda self, df, run, name: df.withColumn(name, F.lit(False)))
    got = sorted((str(r["doc_id"]), r["group_size"]) for r in exact_dedup.exact_dedup(odd_documents).collect())
    assert got != want


def test_line_dedup_anti_joins_its_runs(spark, monkeypatch):
    calls = []
    seen = line_dedup.LineRuns.seen
    monkeypatch.setattr(line_dedup.LineRuns, "seen", lambda self, batch: calls.append(len(self._paths())) or seen(self, batch))
    line = "a line of more than forty characters that all of them have in common"
    df = spark.createDataFrame([(k, f"{line}\n{k}") for k in range(40)], "doc_id long, text string")
    out = line_dedup.dedup_lines(df, batches=4)
    assert calls == [0, 1, 1, 2] and out.where("n_dropped = 1").count() == 39


def test_filters_are_sized_by_their_keys():
    sizes = [filter_bits(n) for n in (0, 10, 1 << 16, 1 << 20, 1 << 26, (1 << 26) + 1)]
    assert sizes == [1 << 20, 1 << 20, 1 << 20, 1 << 24, 1 << 30, None]


def test_scratch_tables_are_cleared(spark, odd_documents):
    from pathlib import Path

    base = Path(shared_dir(spark).removeprefix("file://")) / f"tessella-{spark.sparkContext.applicationId}"
    before = set(base.iterdir()) if base.exists() else set()
    out = near_dedup.near_duplicates(odd_documents)
    assert {p.name.rsplit("-", 1)[0] for p in set(base.iterdir()) - before} == {"near-placed", "near-first"} and out.count() > 0


def test_draws_are_exact_at_any_share(spark):
    df = spark.range(300_000).select("id", (F.col("id") % 3).alias("g"))
    one = sorted(r["id"] for r in drawn(df, 2, "id").collect())
    assert len(one) == 2 and one == sorted(r["id"] for r in drawn(df.repartition(7), 2, "id").collect())
    assert [r["count"] for r in drawn(df, 5, "id", by="g").groupBy("g").count().collect()] == [5, 5, 5]
    same = spark.range(2000).select(F.lit(None).cast("long").alias("id"))  # repeats of one null id share a hash
    assert drawn(same, 3, "id").count() == 3 and drawn(same.limit(0), 3, "id").count() == 0
    assert drawn(df.where("id < 4"), 9, "id").count() == 4


def brute_lines(rows, least=40, docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if len(held[key(x)]) < docs or i == max((j for j in held[key(x)] if j is not None), default=None)]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup_on_odd_rows(odd_documents, odd_rows, batches):
    found = line_dedup.dedup_lines(odd_documents, batches=batches).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found), key=repr) == brute_lines(odd_rows)


def test_line_dedup_of_nothing(no_documents):
    assert line_dedup.dedup_lines(no_documents).count() == 0


def test_line_runs_compact_by_level(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(bytes([k % 3]), k), (b"z", k)], "hash binary, id long")
        if k:
            assert {bytes(r["hash"]) for r in runs.unseen(batch).collect()} == ({bytes([k])} if k < 3 else set())
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(bytes(r["hash"]), r["n_docs"], r["last_id"]) for r in runs.merged().collect()} == {(b"\0", 2, 3), (b"\1", 2, 4), (b"\2", 1, 2), (b"z", 5, 4)}


def test_filter_has_no_false_negative(spark):
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    found = in_filter(spark.range(5000).select(F.col("id").alias("k")), [F.col("k")], key_filter(keys, [F.col("k")], 1 << 16), "maybe", 1 << 16)
    hits = {r["k"] for r in found.where("maybe").collect()}
    assert hits >= set(range(0, 5000, 7)) and len(hits) < 1500


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.sampled_from([0.5, 0.8, 0.9]))
def test_banded_alignment_equals_plain(a, b, similarity):
    expected = plain_edits(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    assert near_dedup.edit_similar(np.array(a, np.uint32), np.array(b, np.uint32), similarity) == expected


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    data = np.frombuffer(" ".join(f"w{i * i}" for i in range(500)).encode(), np.uint8)
    whole = near_dedup.hash_words(data)
    assert len(whole) == 500 == len(np.unique(whole))
    monkeypatch.setattr(near_dedup, "WINDOW", 37)
    assert (near_dedup.hash_words(data) == whole).all()
    monkeypatch.setattr(near_dedup, "WINDOW", 2)
    assert (near_dedup.hash_words(data) == whole).all()


@pytest.mark.parametrize("seed, n", [(0, 0), (1, 12), (2, 30), (3, 60)])
def test_components_equal_union_find(spark, seed, n):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 41, (n, 2))] + [(100 + k, 101 + k) for k in range(n)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def near_truth(rows):
    words = {}
    for i, t in rows:
        words.setdefault(" ".join(re.sub(r"[\W_]+", " ", (t or "").lower()).split()), []).append(i)
    texts = list(words)
    hashed = [near_dedup.hash_words(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    sets = [set(near_dedup.shingles(h).tolist()) for h in hashed]
    holders, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            shared.update((j, k) for j in holders[x])
            holders[x].append(k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9 and near_dedup.edit_similar(hashed[a], hashed[b]):
            links += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    classes = defaultdict(list)
    for k, t in enumerate(texts):
        classes[find(k)] += words[t]
    return links, {frozenset(c) for c in classes.values()}


def test_near_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + k, " ".join(f"w{(k * 31 + j * j) % 9973}" if j % 40 == k % 40 else f"w{j}" for j in range(400))) for k in range(60)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links, classes = near_truth(rows)
    found = defaultdict(set)
    out = near_dedup.near_duplicates(docs).collect()
    for r in out:
        found[r["class_id"]].add(r["doc_id"])
        assert r["class_id"] <= r["doc_id"] and r["kept"] == (r["class_id"] == r["doc_id"])
    assert len(out) == len(rows) and links >= 5
    assert {frozenset(x) for x in found.values()} == classes


def test_near_dedup_on_odd_rows(odd_documents, odd_rows, no_documents):
    out = near_dedup.near_duplicates(odd_documents).collect()
    assert len(out) == len(odd_rows)
    by = {(r["doc_id"], r["words_md5"]): r for r in out}
    classes = defaultdict(list)
    for r in out:
        classes[r["class_id"]].append(r)
    assert {r["doc_id"] for r in classes[1]} == {1, 2, 3, None} and {r["doc_id"] for r in classes[7]} == {7, 8}
    assert {r["doc_id"] for r in classes[4]} == {4, 5, 6, None}
    assert all(sum(r["kept"] for r in c) == 1 and len(c) == c[0]["class_size"] for c in classes.values())
    assert any(k[0] == 8 and r["n_links"] == 1 for k, r in by.items())
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_keep_rows_gives_rows_back_whole(odd_documents):
    decided = saved(exact_dedup.exact_dedup(odd_documents), "decided")
    left = keep_rows(odd_documents, decided, "doc_id", F.sha2(exact_dedup.normalised("text"), 256), "text_sha256")
    assert left.columns == odd_documents.columns and left.count() == decided.where("kept").count()
    assert left.where("_row <> 'clash' OR digest <> 'clash'").count() == 0


def test_neighbours_are_the_same_however_a_group_is_cut(spark):
    rooted = spark.range(3000).selectExpr("1L AS key", "id AS node", "10L AS size", "id AS root", "3000L AS n")
    whole, cut = (sorted(map(tuple, near_dedup._neighbours(rooted, stretch).collect())) for stretch in (10**6, 512))
    assert len(whole) == 2999 + 2998 and cut == whole


def test_near_dedup_links_all_pairs_under_a_shared_passage(spark):
    """Each text shares 88 of its 100 shingles with all others (0.786 alike); planted pairs share 90 (0.818 alike)."""
    passage = " ".join(f"common{j}" for j in range(92))
    text = lambda own, k: " ".join([passage, *(f"own{own}x{j}" for j in range(2)), *(f"tail{k}x{j}" for j in range(10))])
    rows = [(k, text(k // 2 if k < 120 else k, k)) for k in range(2400)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(out) == 2400
    assert {r["doc_id"]: r["class_id"] for r in out} == {k: k // 2 * 2 if k < 120 else k for k in range(2400)}


def test_prefixes_leave_no_alike_pair_out(spark):
    rng = np.random.default_rng(4)
    sets = [sorted({int(x) for x in rng.choice(24, int(n), replace=False)}) for n in rng.integers(1, 14, 160)]
    pairs, close = near_dedup._sharing(spark.createDataFrame([(k, k // 2, s) for k, s in enumerate(sets)], "node long, root long, tokens array<long>"), 1000)
    assert close.isEmpty()
    found = {(r["u"], r["v"]) for r in pairs.collect()}
    alike = {(a, b) for a in range(160) for b in range(a) if a // 2 != b // 2 and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) - 1e-9}
    assert alike and alike <= found


def family(rng, n, size, copies_of_copies=0):
    """Copies of one text, each with words of its own at random places; some are copies of such copies."""
    base = [f"base{j}" for j in range(size)]
    out = []
    for k in range(n):
        words = list(out[int(rng.integers(len(out)))] if k < copies_of_copies and out else base)
        for at in rng.choice(size, int(rng.integers(0, 7)), replace=False):
            words[at] = f"new{rng.integers(200)}"
        out.append(words)
    return out


def plain_links(texts):
    """Pairs by word lists alone: sets of five-word tuples, and edits counted by a plain table."""
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    return {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and plain_edits(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9}


@pytest.mark.parametrize("hot", [2, 32])
def test_near_dedup_against_word_lists(spark, monkeypatch, hot):
    """Classes of a family of copies and of unrelated texts, against links found without any of the operator's code."""
    monkeypatch.setattr(near_dedup._sharing, "__defaults__", (hot,))
    rng = np.random.default_rng(hot)
    texts = family(rng, 150, 90, copies_of_copies=60) + family(rng, 40, 60) + [[f"z{k}x{j}" for j in range(50)] for k in range(20)]
    texts += [t[45:] + t[:45] for t in texts[:8]]  # the same shingles but for a few, in another order
    links = plain_links(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = near_dedup.near_duplicates(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)).collect()
    found = {r["doc_id"]: r["class_id"] for r in out}
    lost = [(a, b) for a, b in links if found[a] != found[b]]
    print(f"{len(lost)} of {len(links)} links lost")
    assert len(links) > 200 and len(lost) <= 0.1 * len(links)
    assert all(find(a) == find(b) for a in found for b in [found[a]])  # nothing is joined without a link


def test_difference_filter_leaves_no_alike_pair_out_and_few_others(spark):
    rng = np.random.default_rng(8)
    centre = set(range(100))
    sets = []
    for k in range(400):
        mine = (centre - set(rng.choice(100, int(rng.integers(0, 40)), replace=False).tolist())) | {1000 + k * 50 + j for j in range(int(rng.integers(0, 12)))}
        sets.append(mine | ({999_000 + k // 2 * 20 + j for j in range(20)} if k < 60 else set()))
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    near = [alike(x, centre) for x in sets]
    rows = [(k, 999, 0 if near[k] else k + 1, 0, len(x), near_dedup.LINKED if near[k] else near_dedup.UNLIKE, sorted(x ^ centre)) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "u long, v long, root long, v_root long, size int, status int, tokens array<long>")
    found = {(r["u"], r["v"]) for r in near_dedup._unlinked_pairs(df).collect()}
    want = {(a, b) for a in range(400) for b in range(a) if alike(sets[a], sets[b]) and not (near[a] and near[b])}
    assert want and want <= found
    # Copies with changes of their own only are proven unlike without being paired.
    own = [(centre - set(range(k % 80, k % 80 + 12))) | {1000 + k * 50 + j for j in range(12)} for k in range(400)]
    rows = [(k, 999, k + 1, 0, len(x), near_dedup.UNLIKE, sorted(x ^ centre)) for k, x in enumerate(own)]
    assert all(len(x ^ centre) > near_dedup.SPREAD * 200 for x in own)
    pairs = near_dedup._unlinked_pairs(spark.createDataFrame(rows, df.schema)).collect()
    want = {(a, b) for a in range(400) for b in range(a) if alike(own[a], own[b])}
    assert want <= {(r["u"], r["v"]) for r in pairs} and len(pairs) < 400 * 20


def test_alignment_of_long_reordered_texts_takes_little_memory():
    import tracemalloc

    words = np.random.default_rng(1).integers(0, 2**32, 20_000).astype(np.uint32)
    swapped = np.concatenate([words[10_000:], words[:10_000]])
    tracemalloc.start()
    assert not near_dedup.edit_similar(words, swapped) and near_dedup.edit_similar(words, np.concatenate([words[:9000], words[10_000:]]))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.sampled_from([0, 2, 48]))
def test_alignment_equals_plain_edits(a, b, few):
    before, near_dedup.FEW_EDITS = near_dedup.FEW_EDITS, few
    try:
        want = plain_edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        assert near_dedup.edit_similar(np.array(a, np.uint32), np.array(b, np.uint32)) == want
    finally:
        near_dedup.FEW_EDITS = before
