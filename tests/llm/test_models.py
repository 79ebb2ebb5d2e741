import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import entries, language_id, maxent_lm, quality_rules, tiff
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def held(i, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == rest


def documents(spark, sf=SF):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_language_held_out_accuracy(spark):
    docs = documents(spark)
    rows = entries.op10_language_id(spark, SF).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == held(r["doc_id"], 0) and 0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in test]) > 0.97


def test_language_mixtures(spark):
    docs = list(documents(spark).values())
    clean = {x: [r["text"] for r in docs if r["lang"] == x and 1000 < len(r["text"]) < 4000] for x in ("en", "de", "fr")}
    model = language_id.train_language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    mixed = clean["en"][0][:900] + " " + clean["de"][0][:500]
    rows = spark.createDataFrame([(1, mixed), (2, clean["fr"][1]), (3, None), (4, ""), (5, "12 .."), (6, "é")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify_languages(rows, model).collect()}
    assert found[1]["langs"] == "en,de" and 0.5 < found[1]["score"] < 0.8
    assert found[2]["lang_pred"] == "fr" and found[2]["score"] > 0.9
    assert all((found[k]["lang_pred"], found[k]["score"]) == ("und", 0.0) for k in (3, 4, 5)) and found[6]["lang_pred"] in model.langs


def test_language_on_odd_rows(odd_documents, odd_rows, no_documents):
    model = language_id.train_language_model(odd_documents)
    out = language_id.identify_languages(odd_documents, model, keep=odd_documents.columns)
    assert out.count() == len(odd_rows) and out.columns[: len(odd_documents.columns)] == odd_documents.columns
    empty = language_id.train_language_model(no_documents)
    assert empty.langs == [] and language_id.identify_languages(no_documents, empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(odd_documents, empty).collect()} == {"und"}


def test_mixture_fit_is_a_maximum():
    rng = np.random.default_rng(1)
    segments = [rng.normal(0, 3, (n, 3)) for n in (1, 5, 40)]
    weights, chosen = language_id.mixtures(segments, 3, penalty=-1e9, rounds=300)
    for s, w in zip(segments, weights):
        value = lambda p: np.log(np.exp(s) @ p).sum()  # noqa: E731, B023
        assert abs(w.sum() - 1) < 1e-9 and all(value(w) >= value(q) - 1e-3 for q in rng.dirichlet([1, 1, 1], 300))
    assert (chosen == 1).sum() >= 6


def plain_mixture(joint, penalty=4.0, rounds=12):
    """One document's proportions and set of languages, by plain loops over its segments."""
    n_langs = len(joint[0])

    def fit(chosen):
        w = [c / sum(chosen) for c in chosen]
        for _ in range(rounds):
            total = [0.0] * n_langs
            for row in joint:
                p = [w[k] * np.exp(max(row[k] - max(row), -60)) for k in range(n_langs)]
                total = [t + x / sum(p) for t, x in zip(total, p)]
            w = [t / len(joint) for t in total]
        return w, sum(np.log(sum(w[k] * np.exp(max(row[k] - max(row), -60)) for k in range(n_langs))) for row in joint)

    chosen = [1] * n_langs
    w, value = fit(chosen)
    toll = penalty + 0.5 * np.log(len(joint))
    trial = [int(x >= 0.02 or k == int(np.argmax(w))) for k, x in enumerate(w)]
    new, fitted = fit(trial)
    if value - fitted < toll:
        chosen, w, value = trial, new, fitted
    while sum(chosen) > 1:
        trial = chosen.copy()
        trial[min((x, k) for k, x in enumerate(w) if chosen[k])[1]] = 0
        new, fitted = fit(trial)
        if value - fitted >= toll:
            break
        chosen, w, value = trial, new, fitted
    return w, chosen


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(6)
    segments = []
    for n in (1, 2, 7, 30, 60):
        for _ in range(4):
            like = rng.normal(0, 2, (n, 4))
            like[np.arange(n), rng.integers(0, 2, n)] += 5
            segments.append(like)
    weights, chosen = language_id.mixtures(segments, 4)
    for s, w, c in zip(segments, weights, chosen):
        want, kept = plain_mixture(s.tolist())
        assert c.tolist() == kept and np.allclose(w, want, atol=1e-6)


def test_rule_weights_are_the_lassos_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, len(quality_rules.STATISTICS)))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) + 1.5 * (x[:, 3] < -0.5) - 1)))).astype(float)
    model = quality_rules.fit_rules(x, y, trees=6, penalty=0.004, steps=3000)
    h = quality_rules._holds([r for r, _ in model.rules], x)
    w = np.array([v for _, v in model.rules])
    wrong = 1 / (1 + np.exp(-(model.intercept + h @ w))) - y
    assert 1 <= len(w) < 60 and abs(wrong.mean()) < 1e-3
    assert np.abs((h - h.mean(axis=0)).T @ wrong / len(y) + 0.004 * np.sign(w)).max() < 2e-4  # stationary where a weight is not 0


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = entries.op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(documents(spark))
    assert all(r["held_out"] == held(r["doc_id"], 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in test]) > 0.95


def test_rules_compile_to_the_same_scores(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    stats = quality_rules.with_statistics(docs).select("doc_id", "_stats.*").toPandas()
    x = stats[quality_rules.STATISTICS].to_numpy(float)
    y = (x[:, 0] > np.median(x[:, 0])).astype(float)
    model = quality_rules.fit_rules(x, y, trees=4)
    assert model.rules
    total = model.intercept + sum(w * quality_rules._holds([r], x)[:, 0] for r, w in model.rules)
    mine = quality_rules.score_quality(docs, model).select("doc_id", "_score").toPandas().set_index("doc_id")["_score"].loc[stats["doc_id"]]
    assert np.allclose(mine, 1 / (1 + np.exp(-total))) and ((mine > 0.5) == (y > 0)).mean() > 0.95


def test_quality_without_labels_and_odd_rows(spark, odd_documents, odd_rows, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    packed = odd_documents.select(F.struct("*").alias("row"), "doc_id", "text")
    for labels in (none, some):
        model = quality_rules.train_quality_rules(packed, labels)
        scored = quality_rules.score_quality(packed, model).select("row.*", "_score")
        assert scored.count() == len(odd_rows) and scored.where("_score < 0 OR _score > 1 OR _score IS NULL").count() == 0
    assert quality_rules.score_quality(no_documents.select("text"), model).count() == 0


def plain_base(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i, 1) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(ws), sum(counts[w] > 0 for w in ws), sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens]


def same_base(found, rows):
    n, expected = plain_base(rows)
    key = lambda x: (str(x[0]), round(x[3], 6), x[1:3])
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in found), key=key)
    for a, b in zip(mine, sorted(expected, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6)
    assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"], 1) for r in found)


def test_language_model(spark):
    docs = documents(spark)
    found = entries.op5_maxent_lm(spark, SF).collect()
    same_base(found, [(i, r["text"]) for i, r in docs.items()])
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in found)


def test_language_model_on_odd_rows(spark, odd_documents, odd_rows, no_documents, monkeypatch):
    same_base(maxent_lm.score_language(odd_documents, maxent_lm.holds_out(), updates=2).collect(), odd_rows)
    assert maxent_lm.score_language(no_documents, maxent_lm.holds_out()).count() == 0
    nothing = maxent_lm.score_language(odd_documents, F.lit(True)).collect()
    assert all(r["base_score"] == 0 and r["score"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_language_model_topics_come_from_all_training_texts(spark, monkeypatch):
    """Frequent words and topics against plain counts over every training text, and the same however the rows lie."""
    kept, counted = [], maxent_lm._counted
    monkeypatch.setattr(maxent_lm, "_counted", lambda words, seeds: (kept.append(seeds), counted(words, seeds))[1])
    entries.op5_maxent_lm(spark, SF)
    seeds = kept[0]
    hash_of = lambda w: int(maxent_lm.hash_words(np.frombuffer(w, np.uint8))[0])
    texts = [Counter((r["text"] or "").encode().lower().split()) for i, r in documents(spark).items() if not held(i, 1)]
    assert len(texts) > 600
    holding = Counter(w for t in texts for w in t)
    named = {hash_of(w): w for w in holding}
    top = sorted(holding.values(), reverse=True)
    assert [holding[named[int(h)]] for h in seeds.frequent_hashes()] == top[: maxent_lm.FREQUENT]
    words = [named[int(h)] for h in seeds.hashes]
    assert len(set(words)) == len(words) and [holding[w] for w in words] == top[: maxent_lm.SEED_WORDS]

    unit = lambda v: np.rint(maxent_lm.SCALE * v / np.sqrt((v * v).sum())) if v.any() else v
    x = np.array([unit(np.sqrt([t[w] for w in words])) for t in texts if any(t[w] for w in words)])
    company = [unit(sum(v * v[k] for v in x)) for k in range(len(words))]
    first = [0]
    while len(first) < maxent_lm.TOPICS:
        first.append(int(np.argmin([max(company[k] @ c for k in first) for c in company])))
    centres = [company[k] for k in first]
    for _ in range(12):
        own = [int(np.argmax([v @ c for c in centres])) for v in x]
        centres = [unit(sum(v for v, o in zip(x, own) if o == k)) if k in own else c for k, c in enumerate(centres)]
    assert np.array_equal(seeds.centres, centres)

    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), maxent_lm.holds_out().alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    again = maxent_lm.Seeds.of(maxent_lm._tokenised(rows.repartition(7)))
    assert np.array_equal(again.hashes, seeds.hashes) and np.array_equal(again.centres, seeds.centres)


def test_language_model_gives_a_rare_language_a_topic(spark):
    """One text of 3000 in words of its own, which no bounded draw of texts is sure to hold."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 40}" for j in range(12)) for i in range(2999)] + [" ".join(f"rare{j}" for j in range(12))]
    seeds = maxent_lm.Seeds.of(maxent_lm._tokenised(spark.createDataFrame([(i, False, t.encode()) for i, t in enumerate(texts)], "id long, held_out boolean, text binary").repartition(3)))
    hashes = maxent_lm.hash_words(np.frombuffer(" ".join([texts[-1], texts[0]]).encode(), np.uint8))
    rare, common, _ = seeds.topics(np.arange(24), np.array([12, 12, 0]), seeds.places(hashes))
    assert len(seeds.hashes) == 52 and rare != common


def test_language_model_equals_plain_loops(spark, odd_documents, monkeypatch):
    """Every score again, token by token, from the weights, classes, keys and shares that the model ended up with."""
    kept = {}
    scored = maxent_lm._scored

    def keep(measured, weights, tables, theta, totals, id_type):
        kept.update(rows=measured.collect(), weights=weights, tables=tables, theta=theta, totals=totals)
        return scored(measured, weights, tables, theta, totals, id_type)

    monkeypatch.setattr(maxent_lm, "_scored", keep)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for docs in (odd_documents.select("doc_id", "text"), spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("doc_id % 9 < 2").select("doc_id", "text")):
        found = sorted((str(r["doc_id"]), round(r["base_score"], 6), r["score"]) for r in maxent_lm.score_language(docs, maxent_lm.holds_out()).collect())
        t, mine = kept["tables"], []
        assert len(found) < 20 or (t.size and np.abs(kept["theta"]).max() > 0.1)
        for r in kept["rows"]:
            marks, keys = np.frombuffer(r["a"], np.uint8), np.frombuffer(r["b"], np.uint16)
            total, history = r["shares"], [maxent_lm.END_CLASS] * 3
            for i, m in enumerate(marks):
                c = int(m) & 127
                if m < 128:
                    a, b, d = history
                    rows = [int(np.uint64(x) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % maxent_lm.HASHED for x in (0, 1 + a, 1000 + b, 2000 + d, 10_000 + a * 64 + b, 20_000 + a * 64 + d)]
                    total += np.log10(softmax(sum(kept["weights"][x].astype(float) for x in rows))[c])
                    if (t.per_group[c] > 0).sum() > 1:
                        before = [int(keys[i - k]) if i >= k else maxent_lm.END_KEY for k in (1, 2)]
                        at = [k * t.size + int(t.start[c]) + int(np.uint64(x + 1 + 65536 * k) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % int(t.width[c]) for k, x in enumerate(before)]
                        n = t.per_group[c] * np.exp(sum(kept["theta"][x].astype(float) for x in at))
                        total += np.log10(n[keys[i] & 15] / n.sum())
                history = [c, *history[:2]]
            mine.append((str(r["id"]), round(r["base_score"], 6), total))
        for x, y in zip(found, sorted(mine), strict=True):
            assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-4, abs=1e-3)


def test_word_factor_is_a_softmax_and_updates_follow_the_gradient():
    rng = np.random.default_rng(2)
    per_group = np.zeros((maxent_lm.CLASSES, maxent_lm.GROUPS), np.int64)
    per_group[:3] = rng.integers(0, 50, (3, maxent_lm.GROUPS))
    per_group[:3, 11] = 0
    per_group[3, 5] = 70
    tables = maxent_lm.WordTables(per_group, 64)
    n = 4000
    marks = rng.integers(0, 4, n).astype(np.uint8)
    keys = rng.integers(0, 9, n).astype(np.uint16)
    keys[1:][marks[1:] < 3] = (keys[:-1] * 7 % 16)[marks[1:] < 3]  # the word before predicts
    keys = np.where(per_group[np.minimum(marks, 2), keys & 15] > 0, keys, np.array([per_group[min(m, 2)].argmax() for m in marks])).astype(np.uint16)
    batch = [(marks, keys, np.array([0, 1500]))]
    at, rows, groups = tables.select(*batch[0])
    assert (marks[at] < 3).all() and len(at) == (marks < 3).sum()
    theta = rng.normal(0, 0.3, (2 * tables.size, 16)).astype(np.float32)
    value = lambda th: tables.log_probs(th, rows, marks[at])[np.arange(len(at)), groups].astype(float).sum()
    p = np.exp(tables.log_probs(theta, rows, marks[at]))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and p[per_group[marks[at]] == 0].max() < 1e-9
    observed, expected = maxent_lm.word_counts(tables, None, iter(batch)), maxent_lm.word_counts(tables, theta, iter(batch))
    assert observed.sum() == pytest.approx(2 * len(at)) and expected.sum() == pytest.approx(2 * len(at), rel=1e-4)
    for _ in range(20):  # the gradient is the observed less the expected counts
        i, j = rng.integers(len(theta)), rng.integers(16)
        up, down = theta.astype(float), theta.astype(float)
        up[i, j] += 1e-3
        down[i, j] -= 1e-3
        assert (value(up) - value(down)) / 2e-3 == pytest.approx(observed[i, j] - expected[i, j], abs=0.02 + 0.01 * float(observed[i, j]))
    theta, before = np.zeros_like(theta), -np.inf
    for _ in range(4):
        now = value(theta)
        assert now > before
        before = now
        theta = maxent_lm.stepped(theta, observed, maxent_lm.word_counts(tables, theta, iter(batch)))


def test_log_probs_are_normalised_and_training_helps():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 8, 5000)
    seq[2::3] = seq[1::3][: len(seq[2::3])]  # the class before predicts
    starts = np.array([0, 2500])
    codes = maxent_lm.histories(seq.astype(np.uint8), starts)
    assert codes[2500] == codes[0] == codes.max()
    grams, n = np.unique(codes * maxent_lm.CLASSES + seq, return_counts=True)
    weights = np.zeros((maxent_lm.HASHED, maxent_lm.CLASSES), np.float32)
    loss = lambda: -maxent_lm.log_probs(weights, codes)[np.arange(len(seq)), seq].mean()
    before = loss()
    observed = maxent_lm.part_sums(grams, n, None)
    assert observed.sum() == pytest.approx(len(seq) * maxent_lm.N_FEATURES)
    for _ in range(10):
        expected = maxent_lm.part_sums(grams, n, weights)
        weights += ((2 / maxent_lm.N_FEATURES) * (observed - expected) / (observed + expected + 1)).astype(np.float32)
        now = loss()
        assert now < before + 1e-6
        before = now
    assert np.allclose(np.exp(maxent_lm.log_probs(weights, codes[:50])).sum(axis=1), 1) and before < 2.2


@pytest.mark.parametrize("kind", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_codecs_round_trip(kind):
    rng = np.random.default_rng(kind)
    for n in (0, 1, 2, 127, 128, 129, 4000, 40000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n), rng.integers(97, 100, n, dtype=np.uint8).tobytes()):
            assert tiff.decompress(tiff.compress(data, kind), kind, n) == data


def test_tiff_pages(spark):
    rng = np.random.default_rng(0)
    shapes = [(1, 1, 1), (5, 7, 3), (70, 33, 1)]
    pages = [tiff.Page(rng.integers(0, 256 ** (d // 8), s).astype(f"u{d // 8}"), k, p, t, 50, n) for s in shapes for k in (1, 5, 8, 32773) for p in (1, 2) for t in (0, 16) for d in (8, 16) for n in (False, True)]
    media = tiff.write_tiff(pages)
    rows = sorted(tiff.tiff_pages(spark.createDataFrame([(1, media), (2, None), (3, b""), (4, media[:-40]), (5, b"II*\0\x08\0\0\0\0\0\x08\0\0\0")], "doc_id long, media binary")).collect(), key=lambda r: (r["doc_id"], r["page"]))
    good = [r for r in rows if r["doc_id"] == 1]
    assert len(good) == len(pages) and all(bytes(r["pixels"]) == p.pixels.tobytes() and (r["bits"], r["error"]) == (8 * p.pixels.itemsize, None) for r, p in zip(good, pages))
    assert {r["doc_id"] for r in rows} == {1, 3, 4, 5} and all(r["error"] for r in rows if r["doc_id"] in (3, 5))


def test_tiff_big_endian():
    import struct

    data = b"MM\0*\0\0\0\x0a" + b"\x01\x02"
    tags = [(256, 3, 2), (257, 3, 1), (258, 3, 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 1), (279, 4, 2)]
    data += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + bytes(4)
    (page,) = tiff.read_tiff(data)
    assert page.pixels.ravel().tolist() == [1, 2]


def test_pages_use_all_codecs_in_shares():
    kinds, predicted, tiled = Counter(), 0, 0
    for k in range(400):
        (page,) = tiff.read_tiff(tiff.bytes_to_tiff(f"text {k}".encode().ljust(128)))
        kinds[page.compression] += 1
        predicted, tiled = predicted + (page.predictor == 2), tiled + bool(page.tile)
    assert all(70 <= kinds[k] <= 130 for k in (tiff.LZW, tiff.PACKBITS)) and 160 <= min(predicted, tiled) <= max(predicted, tiled) <= 240


def test_media_query(spark, odd_documents, odd_rows, no_documents):
    import hashlib

    docs = documents(spark, f"{DATA}/sf0.001")
    pairs = [(r, docs[r["doc_id"]]["text"]) for r in entries.op4_media_tiff(spark, f"{DATA}/sf0.001").collect()]
    assert len(pairs) == len(docs)
    for r, text in pairs:
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        media = tiff.bytes_to_tiff(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and b"".join(p.pixels.tobytes() for p in tiff.read_tiff(media)) == payload
        counts = Counter(payload)
        mean = sum(v * n for v, n in counts.items()) / len(payload)
        sd = (sum(n * (v - mean) ** 2 for v, n in counts.items()) / len(payload)) ** 0.5
        entropy = -sum(n / len(payload) * np.log2(n / len(payload)) for n in counts.values())
        found = [float(x.split("=")[1]) for x in r["feature"].split(";")]
        assert found == pytest.approx([mean, sd, entropy], abs=1e-4)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:])) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert tiff.media_digests(odd_documents).count() == len(odd_rows) and tiff.media_digests(no_documents).count() == 0
