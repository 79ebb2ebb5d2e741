"""Multilingual language identification: each document is a mixture of languages.

Per-language likelihoods of hashed character trigrams come from labelled text. A document is cut into segments of
consecutive trigrams; expectation-maximisation estimates its language proportions from the segments' likelihoods, and
the set of languages is chosen by penalised likelihood, taking out the weakest as long as the penalty outweighs it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import crc_of_id, drawn, saved, tidy
from tessella.shipping import ship

UNDETERMINED = "und"
BUCKETS = 1 << 16
SEGMENT = 32


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Hashes of the character trigrams around each letter; all that is no letter counts as one kind of boundary."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[codes]
    if not letters.any():
        return np.empty(0, np.int64)
    c = np.zeros(len(codes) + 2, np.uint32)
    c[1:-1] = np.where(letters, codes, 0)
    mixed = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ mixed >> np.uint32(15)) & np.uint32(BUCKETS - 1))[letters].astype(np.int64)


@dataclass
class LanguageModel:
    """log P(trigram | language): ``logp`` is (buckets, languages)."""

    langs: list[str]
    logp: np.ndarray

    @classmethod
    def from_counts(cls, counts: dict[str, dict[int, int]], smoothing: float = 0.5) -> LanguageModel:
        langs = sorted(counts)
        table = np.full((BUCKETS, len(langs)), smoothing)
        for k, lang in enumerate(langs):
            for bucket, n in counts[lang].items():
                table[bucket, k] += n
        return cls(langs, np.log(table / table.sum(axis=0)).astype(np.float32))

    def segments(self, text: str) -> np.ndarray:
        """(segments, languages) log-likelihoods."""
        grams = trigrams(text)
        if not len(grams):
            return np.empty((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.logp[grams], np.arange(0, len(grams), SEGMENT), axis=0)


def mixtures(segments: list[np.ndarray], n_langs: int, penalty: float = 4.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions and selected sets of many documents at once: (documents, languages) each.

    A language leaves the set if the log-likelihood lost is less than ``penalty`` + log(segments) / 2.
    """
    sizes = np.array([len(s) for s in segments])
    owner = np.repeat(np.arange(len(segments)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joint = np.concatenate(segments).astype(np.float64)
    top = joint.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(joint - top, -60))

    def fit(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = chosen / chosen.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            resp = like * weights[owner]
            resp /= np.maximum(resp.sum(axis=1, keepdims=True), 1e-300)
            weights = np.add.reduceat(resp, starts, axis=0) / sizes[:, None]
        mass = (like * weights[owner]).sum(axis=1)
        return weights, np.add.reduceat(np.log(np.maximum(mass, 1e-300)), starts)

    chosen = np.ones((len(segments), n_langs))
    weights, fitted = fit(chosen)
    toll = penalty + 0.5 * np.log(sizes)
    open_ = np.ones(len(segments), bool)
    # Most languages have no share at all: they leave together, if that costs less than one of them may.
    trial = np.where(weights >= 0.02, chosen, 0)
    trial[np.arange(len(segments)), weights.argmax(axis=1)] = 1
    for step in range(n_langs + 1):
        if step:
            trial = chosen.copy()
            weakest = np.where(chosen > 0, weights, np.inf).argmin(axis=1)
            trial[np.arange(len(segments)), weakest] = 0
            open_ &= trial.sum(axis=1) > 0
            trial[~open_] = chosen[~open_]
        new_weights, new_fitted = fit(trial)
        better = open_ & (fitted - new_fitted < toll)
        chosen[better], weights[better], fitted[better] = trial[better], new_weights[better], new_fitted[better]
        if step:
            open_ &= better
        if not open_.any():
            break
    return weights, chosen


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, condition: Column | None = None) -> LanguageModel:
    """Count trigrams of ``per_lang`` whole documents of each language (all, if fewer), drawn by a hash of id and text.

    Rows with null text or language, and those that ``condition`` excludes, are never used. The sample is the only bound;
    its counts (languages x buckets at most) go to the driver. Repeated rows are drawn each, up to ``per_lang``.
    """
    ship(docs.sparkSession)
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if condition is None else condition).alias("use")).where("use AND text IS NOT NULL AND lang IS NOT NULL")
    chosen = saved(drawn(usable, per_lang, "id", "text", by="lang", tag="language sample").select("lang", "text"), "language-sample")
    langs = [r["lang"] for r in chosen.select("lang").distinct().collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counts: dict[str, dict[int, int]] = {lang: {} for lang in langs}
    for r in chosen.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["bucket"]] = r["n"]
    return LanguageModel.from_counts(counts)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id (and the columns ``keep``), lang_pred, score (its share of the document), langs (all selected, strongest first).

    ``text_col`` may name a field of a kept struct (``row.text``). A null text, one without letters, and any text when nothing was learned, is ``und`` with score 0. Ties go to the
    first language by name. Repeated rows and null ids pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.logp))
    kept = [id_col] if keep is None else keep
    outer, _, inner = text_col.partition(".")
    nested = kept.index(outer) if inner and outer in kept else None  # the text is in a kept struct: it travels once
    text = [] if nested is not None else [F.col(text_col).alias("text")]
    inputs = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for b in batches:
            pred, score, sets = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows, [""] * b.num_rows
            rows, found, held = [], [], 0

            def settle() -> None:
                if rows:
                    weights, chosen = mixtures(found, len(m.langs))
                    for r, w, c in zip(rows, weights, chosen):
                        best = int(np.argmax(w))
                        pred[r], score[r] = m.langs[best], min(1.0, float(w[best]))
                        sets[r] = ",".join(m.langs[k] for k in np.argsort(-w, kind="stable") if c[k])
                    rows.clear()
                    found.clear()

            if m.langs:
                for r, t in enumerate(b.column(len(kept)) if nested is None else b.column(nested).field(inner)):
                    if t.is_valid and len(s := m.segments(t.as_py())):
                        rows.append(r)
                        found.append(s)
                        held += len(s)
                        if held > 200_000:
                            settle()
                            held = 0
                settle()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], [*b.schema.names[: len(kept)], "lang_pred", "score", "langs"])

    found = inputs.mapInArrow(tidy(run), T.StructType([*inputs.schema.fields[: len(kept)], *T._parse_datatype_string("lang_pred string, score double, langs string").fields]))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score", "langs")


def learns(id_col: str = "doc_id") -> Column:
    """The rows that are learned from; the rest is held out."""
    return crc_of_id(id_col) % 5 != 0
