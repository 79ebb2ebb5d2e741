"""The engine's registered queries over the driver's tables, each with its SQL twin where SQL can express it.

Stand-ins: dataset = ``documents.lang``, shard = ``documents.source``, sample key = ``doc_id``, sidecar = ``labels``,
pixels = ``embeddings``, metric log = ``events``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.display import format_bytes, progress_bar
from tessella.functions.hashrand import seed_text, uniform, uniform_sql
from tessella.operators import batching, masking, mixing, norm, pixels, predicates, sampling, stats, views
from tessella.operators.numbering import numbered
from tessella.plans.pipeline import Pipeline, SampleLoader
from tessella.plans.specs import ContextTargetsSpec, DatasetSpec, EvalSpec, LoaderState, MultiCropConfig, MultiCropSpec, UserSpec
from tessella.plans.weights import MixingWeights
from tessella.shipping import ship
from tessella.sources import catalog, checkpoint, tar
from tessella.sources.images import encode_png
from tessella.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LANGS = ("de", "en", "es", "fr")
WEIGHTS = MixingWeights.of(LANGS, (0.2, 0.5, 0.1, 0.2))
LATER = MixingWeights.of(LANGS, (0.4, 0.1, 0.4, 0.1))
BATCH, WORLD, BUFFER, SWITCH_AT = 32, 3, 64, 300
THRESHOLD = 1.0
SMALL_CROPS = MultiCropConfig(global_crop_size=8, local_crop_size=4, n_global_crops=2, n_local_crops=4)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ds_index():
    out = F.lit(None).cast("int")
    for i, lang in enumerate(LANGS):
        out = F.when(F.col("lang") == lang, F.lit(i)).otherwise(out)
    return out


DS_SQL = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {i}" for i, lang in enumerate(LANGS)) + " END"
NAMES_SQL = "(VALUES " + ", ".join(f"({i}, '{lang}')" for i, lang in enumerate(LANGS)) + ") AS names(ds_idx, name)"


def cut_sql(u: str, later: bool = False) -> str:
    """The dataset index of a uniform, in SQL: the ends of the intervals are written out here."""
    a, b, c = ("0.4", "0.5", "0.9") if later else ("0.2", "0.7", "0.8")
    return f"CASE WHEN {u} < {a}::DOUBLE THEN 0 WHEN {u} < {b}::DOUBLE THEN 1 WHEN {u} < {c}::DOUBLE THEN 2 ELSE 3 END"


def with_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


# --- predicates -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def quality_filter(spark, sf_dir):
    df = with_quality(spark, sf_dir)
    return df.where(predicates.quality_keeps(F.col("quality"), THRESHOLD)).select("doc_id", "lang", "source", "quality")


@query("""SELECT d.doc_id, lang, CASE WHEN toxic = 0 THEN quality END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
          WHERE l.doc_id IS NULL OR coalesce(CASE WHEN toxic = 0 THEN quality END, 1.0) >= 1""")
def quality_filter_strict(spark, sf_dir):
    """A sidecar without a score (here: of a toxic document) counts as 1."""
    df = with_quality(spark, sf_dir).withColumn("score", F.when(F.col("toxic") == 0, F.col("quality")))
    keep = predicates.quality_keeps_default_one(F.col("toxic").isNotNull(), F.col("score").cast("double"), THRESHOLD)
    return df.where(keep).select("doc_id", "lang", "score")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def sidecar_required(spark, sf_dir):
    return with_quality(spark, sf_dir).where(F.col("toxic").isNotNull()).select("doc_id", "lang", "quality", "toxic")


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events WHERE json_extract_string(props, '$.k')::DOUBLE >= 50 OR json_extract_string(props, '$.k') IS NULL")
def sidecar_json_filter(spark, sf_dir):
    """A threshold on a number of a JSON sidecar; rows without it stay."""
    df = table(spark, sf_dir, "events").select("event_id", predicates.sidecar_score("props", "k").alias("k"))
    return df.where(predicates.quality_keeps(F.col("k"), 50.0))


@query("SELECT doc_id AS key, source AS shard_path FROM documents WHERE source <> 'src0' AND lang IN ('en', 'de')")
def sample_predicate(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("shard_path"), F.col("lang").alias("meta"))
    return predicates.where_sample(df, lambda light: (light["shard_path"] != "src0") & light["meta"].isin("en", "de")).select("key", "shard_path")


# --- partitioning and sampling ----------------------------------------------------------------------------------------

SHARDS_SQL = "SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS shard_idx FROM documents GROUP BY lang, source"


def shards(spark, sf_dir):
    return sampling.shard_table(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")


@query(f"SELECT *, shard_idx % {WORLD} AS rank FROM ({SHARDS_SQL})")
def shard_assign(spark, sf_dir):
    return sampling.assign_ranks(shards(spark, sf_dir), WORLD)


@query("SELECT lang, count(DISTINCT source) AS n_shards, count(DISTINCT source) >= 8 AS covered, count(DISTINCT source) // 8 AS least_per_rank, count(DISTINCT source) // 8 < 4 AS few FROM documents GROUP BY lang")
def shard_coverage(spark, sf_dir):
    return sampling.coverage(shards(spark, sf_dir), "lang", 8)


PERM = seed_text("permutation", epoch=3)


@query(f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql(PERM, 'doc_id')}, doc_id) AS pos FROM documents")
def epoch_permutation(spark, sf_dir):
    return sampling.permuted(table(spark, sf_dir, "documents").select("lang", "doc_id"), PERM, "doc_id", ["lang"])


RACE = seed_text("race", epoch=3)


@query(f"""WITH w AS (SELECT doc_id, lang, coalesce(quality, 0.5)::DOUBLE AS weight, {uniform_sql(RACE, 'doc_id')} AS u FROM documents LEFT JOIN labels USING (doc_id)),
           t AS (SELECT *, CASE WHEN weight > 0 THEN -ln(1.0::DOUBLE - u) / weight ELSE 'inf'::DOUBLE END AS t FROM w)
           SELECT lang, doc_id, weight, row_number() OVER (PARTITION BY lang ORDER BY t, doc_id) AS pos FROM t""")
def quality_weighted_permutation(spark, sf_dir):
    """Weight 1 for good, 0 for bad (last), a half for unlabelled documents."""
    df = with_quality(spark, sf_dir).select("lang", "doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("weight"))
    return sampling.weighted_permutation(df, RACE, "doc_id", "weight", ["lang"])


RESAMPLE = seed_text("resample")


@query(f"""WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
           t AS (SELECT lang, n, k - 1 AS t FROM p)
           SELECT t.lang, t.t, p.doc_id FROM t JOIN p ON p.lang = t.lang AND p.k = floor({uniform_sql(RESAMPLE, 't.lang', 't.t')} * t.n) + 1""")
def resampled_draws(spark, sf_dir):
    """As many draws with replacement per dataset as it has samples."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    plan = numbered(docs, "t", [F.col("doc_id")], F.col("doc_id"), ["lang"]).select("lang", (F.col("t") - 1).alias("t"))
    return sampling.resampled(docs, RESAMPLE, "doc_id", "lang", plan).select("lang", "t", "doc_id")


BLOCK = seed_text("block")


@query(f"""WITH p AS (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // {BUFFER} AS block, {uniform_sql(BLOCK, 'doc_id')} AS u FROM documents)
           SELECT lang, doc_id, block * {BUFFER} + row_number() OVER (PARTITION BY lang, block ORDER BY u, doc_id) AS pos FROM p""")
def block_shuffle(spark, sf_dir):
    return sampling.block_shuffled(table(spark, sf_dir, "documents").select("lang", "doc_id"), BLOCK, "doc_id", BUFFER, ["lang"])


ORDER = seed_text("shards", epoch=1)


@query(f"""WITH s AS ({SHARDS_SQL})
           SELECT lang, source, 'sequential' AS mode, shard_idx + 1 AS pos FROM s
           UNION ALL SELECT lang, source, 'epoch', row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql(ORDER, "concat(lang, '/', shard_idx)")}, concat(lang, '/', shard_idx)) FROM s
           UNION ALL SELECT s.lang, p.source, 'resampled', s.shard_idx + 1 FROM s JOIN (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY shard_idx) AS k, count(*) OVER (PARTITION BY lang) AS m FROM s) p
             ON p.lang = s.lang AND p.k = floor({uniform_sql(ORDER, 's.lang', 's.shard_idx')} * p.m) + 1""")
def sampling_modes(spark, sf_dir):
    """Shard order by each sampling mode."""
    s = shards(spark, sf_dir).select("lang", "source", "shard_idx")
    found = [sampling.ordered_shards(s, "lang", mode, ORDER).select("lang", "source", F.lit(mode).alias("mode"), "pos") for mode in ("sequential", "epoch", "resampled")]
    return reduce(DataFrame.unionByName, found)


# --- mixing -----------------------------------------------------------------------------------------------------------


@query(f"WITH c AS (SELECT lang AS name, count(*)::DOUBLE AS w FROM documents GROUP BY lang) SELECT name, w / sum(w) OVER () AS weight FROM c")
def weights_normalise(spark, sf_dir):
    """Sizes of the datasets as weights: a window over one row per dataset."""
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return sizes.select("name", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


@query("""SELECT ds_idx, name, round(raw / 3.8, 9) AS weight, round(lo / 3.8, 9) AS lo, round((lo + raw) / 3.8, 9) AS hi
          FROM (VALUES (0, 'de', 0.2::DOUBLE, 0.0::DOUBLE), (1, 'en', 0.5, 0.2), (2, 'es', 0.1, 0.7), (3, 'fr', 3.0, 0.8)) AS t(ds_idx, name, raw, lo)""")
def weights_set_by_name(spark, sf_dir):
    """One entry of the vector 0.2, 0.5, 0.1, 0.2 becomes 3, and the sum 3.8."""
    return WEIGHTS.with_weight("fr", 3.0).table(spark).select("ds_idx", "name", *[F.round(c, 9).alias(c) for c in ("weight", "lo", "hi")])


MIX, POOL = seed_text("mix"), seed_text("pool")
POOL_SQL = f"SELECT doc_id, {DS_SQL} AS ds_idx, row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql(POOL, 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents"
GOOD_SQL = f"SELECT doc_id, {DS_SQL} AS ds_idx, row_number() OVER (PARTITION BY lang ORDER BY {uniform_sql(POOL, 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1"


def plan_sql(later: bool = False, source: str = "documents") -> str:
    u = uniform_sql(MIX, "t")
    pick = f"CASE WHEN t >= {SWITCH_AT} THEN {cut_sql(u, True)} ELSE {cut_sql(u)} END" if later else cut_sql(u)
    return f"SELECT *, row_number() OVER (PARTITION BY ds_idx ORDER BY t) AS j FROM (SELECT t, {pick} AS ds_idx FROM (SELECT unnest(range((SELECT count(*) FROM {source}))) AS t))"


def pool(spark, sf_dir, good: bool = False) -> DataFrame:
    df = with_quality(spark, sf_dir) if good else table(spark, sf_dir, "documents").select("doc_id", "lang")
    df = df.where(predicates.quality_keeps(F.col("quality"), THRESHOLD)) if good else df
    return sampling.permuted(df.select("doc_id", ds_index().alias("ds_idx")), POOL, "doc_id", ["ds_idx"], "k")


def plan(spark, sf_dir, **options) -> DataFrame:
    return mixing.draws(spark, table(spark, sf_dir, "documents").count(), WEIGHTS, MIX, **options)


CYCLIC_SQL = "SELECT t, d.ds_idx, j, doc_id, (j - 1) // n AS cycle FROM d JOIN p ON p.ds_idx = d.ds_idx AND p.k = (j - 1) % n + 1"


@query(f"WITH d AS ({plan_sql()}), p AS ({POOL_SQL}) {CYCLIC_SQL}")
def mix_cyclic(spark, sf_dir):
    return mixing.mix_cyclic(plan(spark, sf_dir), pool(spark, sf_dir)).select("t", "ds_idx", "j", "doc_id", "cycle")


@query(f"WITH d AS ({plan_sql()}), p AS ({GOOD_SQL}), m AS ({CYCLIC_SQL}) SELECT t // {BATCH} AS batch_id, t % {BATCH} AS slot, ds_idx, doc_id FROM m")
def mix_batches(spark, sf_dir):
    """Scan, quality filter, weighted mix, batches: the shortest whole path."""
    mixed = mixing.mix_cyclic(plan(spark, sf_dir), pool(spark, sf_dir, good=True))
    return batching.with_batch(mixed, "t", BATCH).select("batch_id", "slot", "ds_idx", "doc_id")


@query(f"""WITH d AS ({plan_sql()}), p AS ({POOL_SQL}), s AS (SELECT ds_idx, count(*) AS n FROM p GROUP BY ds_idx),
           cut AS (SELECT coalesce(min(t), (SELECT count(*) FROM d)) AS t FROM d LEFT JOIN s USING (ds_idx) WHERE j > coalesce(n, 0))
           SELECT d.t, d.ds_idx, doc_id FROM d JOIN p ON p.ds_idx = d.ds_idx AND p.k = d.j WHERE d.t < (SELECT t FROM cut)""")
def mix_stop_on_exhausted(spark, sf_dir):
    return mixing.mix_until_exhausted(plan(spark, sf_dir), pool(spark, sf_dir)).select("t", "ds_idx", "doc_id")


@query(f"WITH d AS ({plan_sql()}) SELECT t // {BATCH} AS batch_id, ds_idx, count(*) AS n FROM d GROUP BY ALL")
def mix_provenance(spark, sf_dir):
    """How many samples of each dataset each batch has."""
    return batching.with_batch(plan(spark, sf_dir), "t", BATCH).groupBy("batch_id", "ds_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH d AS ({plan_sql(later=True)}), p AS ({POOL_SQL}), m AS ({CYCLIC_SQL}) SELECT t, ds_idx, doc_id FROM m")
def mix_curriculum(spark, sf_dir):
    """Other weights from a draw on."""
    mixed = mixing.mix_cyclic(plan(spark, sf_dir, schedule=[(SWITCH_AT, LATER)]), pool(spark, sf_dir))
    return mixed.select("t", "ds_idx", "doc_id")


@query(f"WITH d AS ({plan_sql()}), p AS ({POOL_SQL}), m AS ({CYCLIC_SQL}) SELECT cycle, ds_idx, count(*) AS n, count(DISTINCT doc_id) AS n_distinct FROM m GROUP BY ALL")
def mix_restart(spark, sf_dir):
    """A used-up dataset starts over in the same order: per cycle, samples and distinct samples."""
    mixed = mixing.mix_cyclic(plan(spark, sf_dir), pool(spark, sf_dir))
    return mixed.groupBy("cycle", "ds_idx").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_distinct"))


# --- lookups and views ------------------------------------------------------------------------------------------------

SPECS = [DatasetSpec("de", mean=(0.5, 0.5, 0.5)), DatasetSpec("en"), DatasetSpec("es", std=(0.2, 0.25, 0.3)), DatasetSpec("fr", mean=(0.4, 0.4, 0.4), std=(0.25, 0.25, 0.25))]


#: 255 times the channel statistics of SPECS, worked out by hand.
NORM_SQL = """(SELECT ds_idx, mean::DOUBLE[] AS mean, std::DOUBLE[] AS std FROM (VALUES (0, [127.5, 127.5, 127.5], [58.395, 57.12, 57.375]), (1, [123.675, 116.28, 103.53], [58.395, 57.12, 57.375]),
    (2, [123.675, 116.28, 103.53], [51.0, 63.75, 76.5]), (3, [102.0, 102.0, 102.0], [63.75, 63.75, 63.75])) AS v(ds_idx, mean, std)) AS norm"""


def rounded_stats(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("mean", "std")])


@query(f"SELECT * FROM {NORM_SQL}")
def norm_table(spark, sf_dir):
    return rounded_stats(norm.norm_table(spark, SPECS), "ds_idx")


@query(f"SELECT doc_id, d.ds_idx, mean, std FROM (SELECT doc_id, {DS_SQL} AS ds_idx FROM documents) d LEFT JOIN {NORM_SQL} ON norm.ds_idx = d.ds_idx")
def norm_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", ds_index().alias("ds_idx"))
    return rounded_stats(norm.norm_lookup(docs, norm.norm_table(spark, SPECS)), "doc_id", "ds_idx")


@query(f"""SELECT doc_id, d.ds_idx, coalesce(mean, [123.675, 116.28, 103.53]::DOUBLE[]) AS mean, coalesce(std, [58.395, 57.12, 57.375]::DOUBLE[]) AS std
           FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 6)::INT END AS ds_idx FROM documents) d LEFT JOIN {NORM_SQL} ON norm.ds_idx = least(d.ds_idx, 3) AND d.ds_idx IS NOT NULL""")
def norm_clamped(spark, sf_dir):
    """Indices past the table of four take its last row, null indices the fallback."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 6).cast("int")).alias("ds_idx"))
    return rounded_stats(norm.norm_lookup(docs, norm.norm_table(spark, SPECS)), "doc_id", "ds_idx")


@query("SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE) AS data FROM embeddings")
def normalise_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", norm.normalised_vector(F.col("embedding"), F.lit(0.485), F.lit(0.229)).alias("data"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE * 32 + 128 >= 128 THEN 255 - (x::DOUBLE * 32 + 128) ELSE x::DOUBLE * 32 + 128 END) AS data FROM embeddings")
def solarize_vector(spark, sf_dir):
    """Samples of 128 and more are turned over, by the operator on pixels itself."""
    turned = F.pandas_udf(lambda s: s.map(lambda e: pixels.solarized(np.asarray(e, float) * 32 + 128)), "array<double>")
    ship(spark)
    return table(spark, sf_dir, "embeddings").select("vec_id", turned("embedding").alias("data"))


@query("SELECT vec_id, flatten(list_transform(range(8), lambda y: list_reverse(embedding[y * 8 + 1 : y * 8 + 8]))) AS data FROM embeddings")
def flip_vector(spark, sf_dir):
    """An 8 x 8 grid mirrored: each row reversed."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.reverse(F.slice(F.col("embedding"), y * 8 + 1, F.lit(8))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(rows).alias("data"))


CROPS = MultiCropConfig(resolution_schedule=[(0, 98), (10, 224), (30, 448)], max_global_crop_size=448)
VIEWS_SQL = "(VALUES " + ", ".join(
    f"({i}, '{n}', '{k}', {s}, {lo!r}::DOUBLE, {hi!r}::DOUBLE, {b!r}::DOUBLE, {z!r}::DOUBLE)"
    for i, n, k, s, lo, hi, b, z in [
        (i, f"view_{i}", "global" if i < 2 else "local", 224 if i < 2 else 96, *(CROPS.global_crops_scale if i < 2 else CROPS.local_crops_scale), [1.0, 0.1][i] if i < 2 else 0.5, 0.2 if i == 1 else 0.0)
        for i in range(10)
    ]
) + ") AS v(view, name, kind, size, scale_lo, scale_hi, blur_p, solarize_p)"


@query(f"SELECT doc_id, view, name, kind, size, scale_lo, scale_hi, blur_p, solarize_p FROM documents, {VIEWS_SQL}")
def view_fanout(spark, sf_dir):
    """Each sample times ten constant views."""
    return views.fan_out(table(spark, sf_dir, "documents").select("doc_id"), views.view_table(spark, CROPS))


@query("WITH a AS (SELECT doc_id, list_transform(range(10), lambda i: concat('view_', i)) AS v FROM documents) SELECT doc_id, v[1:2] AS first, v[3:10] AS rest FROM a")
def view_split(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("view_"), i.cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", names.alias("v"))
    first, rest = views.split_views(F.col("v"), 2)
    return docs.select("doc_id", first.alias("first"), rest.alias("rest"))


@query("""SELECT kind, i - 1 AS view, names[i] AS name, i <= n_first AS first, masks FROM (VALUES
          ('context', ['context', 'target_0', 'target_1', 'target_2', 'target_3'], 1, false), ('eval', ['view_0'], 1, false),
          ('multicrop', ['view_0', 'view_1', 'view_2', 'view_3', 'view_4', 'view_5', 'view_6', 'view_7', 'view_8', 'view_9'], 2, true),
          ('user', ['a', 'b', 'c'], 1, false)) AS s(kind, names, n_first, masks), unnest(range(1, len(names) + 1)) AS u(i)""")
def view_names(spark, sf_dir):
    """The views that each augmentation kind declares, and to which part of a split they belong."""
    kinds = {"context": ContextTargetsSpec(), "eval": EvalSpec(), "multicrop": MultiCropSpec(), "user": UserSpec(fn=lambda b: {}, views=("a", "b", "c"))}
    rows = [(k, i, n, i < s.n_first, s.supports_masking) for k, s in kinds.items() for i, n in enumerate(s.view_names())]
    return spark.createDataFrame(rows, "kind string, view int, name string, first boolean, masks boolean")


AUG = seed_text("aug")


def _aug(x: str) -> str:
    return uniform_sql(f"{AUG}:{x}", "doc_id", "view")


@query(f"""SELECT doc_id, view, {_aug('flip')} < 0.5 AS flip, {_aug('jitter')} < 0.8 AS jitter, 1.0::DOUBLE - 0.8::DOUBLE + {_aug('brightness')} * 1.6::DOUBLE AS brightness,
           ({_aug('hue')} * 2 - 1) * 0.2::DOUBLE AS hue, {_aug('gray')} < 0.2 AS gray, {_aug('blur')} < blur_p AS blur,
           0.1::DOUBLE + {_aug('sigma')} * (2.0::DOUBLE - 0.1::DOUBLE) AS sigma, {_aug('solarize')} < solarize_p AS solarize FROM documents, {VIEWS_SQL}""")
def aug_params(spark, sf_dir):
    fanned = views.fan_out(table(spark, sf_dir, "documents").select("doc_id"), views.view_table(spark, CROPS))
    return views.with_parameters(fanned, CROPS, AUG, "doc_id", "view").select("doc_id", "view", "flip", "jitter", "brightness", "hue", "gray", "blur", "sigma", "solarize")


@query("SELECT epoch::BIGINT AS epoch, CASE WHEN epoch >= 30 THEN 448 WHEN epoch >= 10 THEN 224 WHEN epoch >= 0 THEN 98 END AS size FROM (SELECT unnest(range(50)) AS epoch)")
def resolution_schedule(spark, sf_dir):
    return spark.range(50).select(F.col("id").alias("epoch"), views.size_at_epoch(F.col("id"), CROPS.resolution_schedule, CROPS.global_crop_size).alias("size"))


IMAGE_SQL = "SELECT p_partkey, p_size * 16 AS width, (p_partkey % 50 + 1)::INT * 16 AS height FROM part"


def image_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).alias("width"), ((F.col("p_partkey") % 50 + 1).cast("int") * 16).alias("height"))


@query(f"SELECT p_partkey, (width * 256) // least(width, height) AS new_w, (height * 256) // least(width, height) AS new_h FROM ({IMAGE_SQL})")
def resize_geometry(spark, sf_dir):
    w, h = views.resized(F.col("width"), F.col("height"), EvalSpec().resize_to)
    return image_sizes(spark, sf_dir).select("p_partkey", w.alias("new_w"), h.alias("new_h"))


CROP = seed_text("crop")


def _crop(x: str) -> str:
    return uniform_sql(f"{CROP}:{x}", "p_partkey")


@query(f"""WITH i AS ({IMAGE_SQL}),
           a AS (SELECT *, width * height * (0.32::DOUBLE + {_crop('area')} * (1.0::DOUBLE - 0.32::DOUBLE)) AS area, exp({math.log(3 / 4)!r}::DOUBLE + {_crop('aspect')} * {math.log(4 / 3) - math.log(3 / 4)!r}::DOUBLE) AS aspect FROM i),
           s AS (SELECT *, greatest(1, least(width, round(sqrt(area * aspect))::INT)) AS crop_w, greatest(1, least(height, round(sqrt(area / aspect))::INT)) AS crop_h FROM a)
           SELECT p_partkey, crop_w, crop_h, floor({_crop('x')} * (width - crop_w + 1))::INT AS "left", floor({_crop('y')} * (height - crop_h + 1))::INT AS top FROM s""")
def crop_geometry(spark, sf_dir):
    df = image_sizes(spark, sf_dir).withColumn("scale_lo", F.lit(0.32)).withColumn("scale_hi", F.lit(1.0))
    return views.random_crop(df, "width", "height", CROP, "p_partkey").select("p_partkey", "crop_w", "crop_h", "left", "top")


# --- batches and pipelines --------------------------------------------------------------------------------------------

LINES_SQL = f"SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem"


def line_stream(spark, sf_dir):
    """lineitem as a long numbered stream."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return numbered(df, "pos", order, F.col("l_orderkey")).withColumn("pos", F.col("pos") - 1)


@query(f"SELECT pos // {BATCH} AS batch_id, count(*) AS n, sum(l_quantity) AS quantity, min(l_orderkey) AS first_key FROM ({LINES_SQL}) GROUP BY 1 HAVING count(*) = {BATCH}")
def batch_drop_last(spark, sf_dir):
    """Only whole batches."""
    rows = batching.with_batch(line_stream(spark, sf_dir), "pos", BATCH)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_orderkey").alias("first_key")).where(F.col("n") == BATCH)


@query(f"SELECT pos // {BATCH} AS batch_id, list(l_orderkey ORDER BY pos) AS keys FROM ({LINES_SQL}) GROUP BY 1")
def batch_collect(spark, sf_dir):
    """Each batch as one row, its samples in slot order."""
    rows = batching.collected(batching.with_batch(line_stream(spark, sf_dir), "pos", BATCH), ["l_orderkey"])
    return rows.select("batch_id", F.transform("samples", lambda s: s["l_orderkey"]).alias("keys"))


BATCHES_SQL = f"SELECT pos // {BATCH} AS batch_id, sum(l_quantity) AS quantity, count(*) AS n FROM ({LINES_SQL}) GROUP BY 1"


def line_batches(spark, sf_dir) -> Pipeline:
    rows = batching.with_batch(line_stream(spark, sf_dir), "pos", BATCH)
    return Pipeline(rows.groupBy("batch_id").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n")))


@query(f"SELECT batch_id, quantity, n FROM ({BATCHES_SQL}) WHERE quantity >= 800")
def pipeline_select(spark, sf_dir):
    return line_batches(spark, sf_dir).select(F.col("quantity") >= 800).dataframe()


@query(f"SELECT batch_id, quantity, n, quantity / n AS mean_quantity FROM ({BATCHES_SQL})")
def pipeline_map(spark, sf_dir):
    return line_batches(spark, sf_dir).map(lambda df: df.withColumn("mean_quantity", F.col("quantity") / F.col("n"))).dataframe()


@query(f"SELECT batch_id, quantity, n FROM (SELECT *, row_number() OVER (ORDER BY batch_id) AS nth FROM ({BATCHES_SQL}) WHERE quantity >= 800) WHERE nth <= 20")
def pipeline_limit(spark, sf_dir):
    """The first 20 batches after all other steps, though the limit is set first."""
    return line_batches(spark, sf_dir).with_epoch(20).select(F.col("quantity") >= 800).dataframe()


@query(f"SELECT 'heavy' AS label, count(*) FILTER (quantity >= 800) AS n_kept, count(*) FILTER (quantity < 800) AS n_skipped FROM ({BATCHES_SQL})")
def batch_filter_stats(spark, sf_dir):
    return line_batches(spark, sf_dir).select(F.col("quantity") >= 800, "heavy").skipped()


@query(f"SELECT batch_id, quantity, n FROM ({BATCHES_SQL}) WHERE batch_id > 100")
def resume_exact(spark, sf_dir):
    """What is left after step 100."""
    return batching.resume_after(line_batches(spark, sf_dir).dataframe(), 100)


# --- state, metrics, catalogue ----------------------------------------------------------------------------------------

LOG_SQL = "SELECT user_id AS job, event_id AS step, datediff('day', TIMESTAMP '1970-01-01', ts) AS epoch, event_type, value, props, ts FROM events"


def state_log(spark, sf_dir):
    """events as a log of checkpoints."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("step"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("epoch"), "event_type", "value", "props", "ts")


@query(f"SELECT job, max_by(step, (epoch, step)) AS latest FROM ({LOG_SQL}) GROUP BY job")
def ckpt_latest(spark, sf_dir):
    return checkpoint.latest_of(state_log(spark, sf_dir), ["job"], "epoch", "step", F.col("step"))


@query(f"SELECT job, step, epoch, row_number() OVER (PARTITION BY job ORDER BY epoch DESC, step DESC) AS age FROM ({LOG_SQL}) QUALIFY age <= 3")
def ckpt_prune(spark, sf_dir):
    return checkpoint.kept_of(state_log(spark, sf_dir).select("job", "step", "epoch"), ["job"], "epoch", "step")


@query(f"SELECT step, sha256(props) AS digest, event_type <> 'view' AS valid FROM ({LOG_SQL})")
def ckpt_verify(spark, sf_dir):
    """Digests of payloads; those of one type carry a wrong one."""
    log = state_log(spark, sf_dir).withColumn("stored", F.when(F.col("event_type") == "view", F.lit("tampered")).otherwise(F.sha2("props", 256)))
    return checkpoint.verified(log, "props", "stored").select("step", F.sha2("props", 256).alias("digest"), "valid")


@query("""WITH l AS (SELECT user_id, event_id, value, ts, lag(value) OVER w AS before, lag(ts) OVER w AS before_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
          SELECT user_id, event_id, CASE WHEN epoch_us(ts) > epoch_us(before_ts) THEN (value - before) / ((epoch_us(ts) - epoch_us(before_ts)) / 1e6::DOUBLE) END AS rate FROM l""")
def metric_rates(spark, sf_dir):
    return stats.rates(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "value", "event_id").select("user_id", "event_id", "rate")


@query("""WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id)
          SELECT user_id, last_ts, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6::DOUBLE AS age_s, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6::DOUBLE > 86400 AS stale FROM l""")
def stale_ranks(spark, sf_dir):
    return stats.stale(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 86400.0)


TIMING_SQL = """SELECT event_type, avg(value) AS mean_ms, coalesce(stddev_samp(value), 0) AS sd_ms, count(*) AS n, median(value) AS median_ms,
                list_sort(list(value))[floor(0.95::DOUBLE * count(*))::INT + 1] AS p95_ms FROM events GROUP BY event_type"""
ROUNDED = "SELECT event_type, round(mean_ms, 6) AS mean_ms, round(sd_ms, 6) AS sd_ms, n, round(median_ms, 6) AS median_ms, round(p95_ms, 6) AS p95_ms FROM"


@query(f"{ROUNDED} ({TIMING_SQL})")
def timing_stats(spark, sf_dir):
    found = stats.timing(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), "event_type", "value", "event_id")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean_ms", "sd_ms")], "n", *[F.round(c, 6).alias(c) for c in ("median_ms", "p95_ms")])


@query("SELECT event_type, round(64.0::DOUBLE / (avg(value) / 1000), 6) AS per_s FROM events GROUP BY event_type")
def throughput(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return means.select("event_type", F.round(stats.throughput(F.col("m"), 64), 6).alias("per_s"))


@query("""WITH m AS (SELECT event_type, 64.0::DOUBLE / (avg(value) / 1000) AS v FROM events GROUP BY event_type), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, event_type DESC) AS k FROM m)
          SELECT a.event_type AS winner, b.event_type AS second, round(a.v / b.v * 100 - 100, 6) AS margin_pct FROM r a, r b WHERE a.k = 1 AND b.k = 2""")
def winner_margin(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    best = stats.winner(means.select("event_type", stats.throughput(F.col("m"), 64).alias("v")), "event_type", "v")
    return best.withColumn("margin_pct", F.round("margin_pct", 6))


@query("SELECT lang, count(*) AS n, count(*) // 64 AS steps FROM documents GROUP BY lang")
def steps_per_epoch(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("steps", stats.steps_per_epoch(F.col("n"), 16, 4))


@query(f"SELECT batch_id, sum(l_linenumber)::BIGINT AS depth FROM (SELECT *, pos // {BATCH} AS batch_id FROM ({LINES_SQL})) WHERE batch_id % 100 = 0 GROUP BY batch_id")
def queue_depths(spark, sf_dir):
    """A gauge that the operator reads every hundredth batch."""
    rows = batching.with_batch(line_stream(spark, sf_dir), "pos", BATCH)
    return rows.where(F.col("batch_id") % 100 == 0).groupBy("batch_id").agg(F.sum("l_linenumber").alias("depth"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN format('{:.2f} B', n) WHEN n < 1048576 THEN format('{:.2f} KB', n / 1024) WHEN n < 1073741824 THEN format('{:.2f} MB', n / 1048576)
          ELSE format('{:.2f} GB', n / 1073741824) END AS shown, repeat('#', floor(share * 24)::INT) || repeat('.', 24 - floor(share * 24)::INT) AS bar
          FROM (SELECT o_orderkey, o_totalprice * o_totalprice AS n, greatest(0::DOUBLE, least(1::DOUBLE, o_totalprice / 500000)) AS share FROM orders)""")
def byte_display(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", format_bytes(F.col("o_totalprice") * F.col("o_totalprice")).alias("shown"), progress_bar(F.col("o_totalprice"), F.lit(500000.0)).alias("bar"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 5000 / s_acctbal ELSE 0 END AS share, CASE WHEN s_acctbal > 0 THEN 5000 / s_acctbal ELSE 0 END >= 0.9 AS warns FROM supplier")
def cache_utilisation(spark, sf_dir):
    share, warns = stats.utilisation(F.lit(5000.0), F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", share.alias("share"), warns.alias("warns"))


PATHS_SQL = """SELECT '/data/' || CASE WHEN lang IN ('en', 'de') THEN 'public' ELSE 'internal' END || '/text/' || lang || '/outputs/default/' || CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END
               || '/shard-' || lpad((doc_id % 7)::VARCHAR, 6, '0') || '.tar' AS path FROM documents"""


def shard_paths(spark, sf_dir):
    conf = F.when(F.col("lang").isin("en", "de"), "public").otherwise("internal")
    split = F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train")
    path = F.concat(F.lit("/data/"), conf, F.lit("/text/"), F.col("lang"), F.lit("/outputs/default/"), split, F.lit("/shard-"), F.lpad((F.col("doc_id") % 7).cast("string"), 6, "0"), F.lit(".tar"))
    return table(spark, sf_dir, "documents").select(path.alias("path")).distinct()


@query(f"""WITH p AS (SELECT DISTINCT path FROM ({PATHS_SQL})), g AS (SELECT path, string_split(path, '/') AS s FROM p)
           SELECT path, s[3] AS confidentiality, s[5] AS dataset, s[8] AS split, regexp_extract(path, 'shard-(\\d+)', 1)::INT AS shard_idx FROM g WHERE s[3] = 'public' AND s[8] = 'train'""")
def catalog_filter(spark, sf_dir):
    found = catalog.CatalogFilter(confidentialities=["public"], splits=["train"], strategy="default").apply(catalog.parse_paths(shard_paths(spark, sf_dir)))
    return found.select("path", "confidentiality", "dataset", "split", "shard_idx")


@query(f"""WITH p AS (SELECT DISTINCT path FROM ({PATHS_SQL})), g AS (SELECT string_split(path, '/') AS s FROM p)
           SELECT s[3] AS confidentiality, s[4] AS modality, s[5] AS dataset, s[7] AS strategy, s[8] AS split, count(*) AS n_shards FROM g GROUP BY ALL""")
def catalog_preview(spark, sf_dir):
    return catalog.preview(catalog.parse_paths(shard_paths(spark, sf_dir)))


@query("SELECT r_regionkey AS level_idx, r_name AS name FROM region WHERE r_regionkey <= (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def confidentiality_levels(spark, sf_dir):
    """Levels up to a given one, with the regions as levels."""
    levels = catalog.Confidentialities()
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # the registry is configuration: a few rows
        levels.register(r["r_name"], f"/data/{r['r_name']}")
    return levels.table(spark).where(F.col("name").isin(levels.all_up_to("ASIA"))).select("level_idx", "name")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, NULL::VARCHAR AS absent FROM events")
def config_roundtrip(spark, sf_dir):
    """A fixed schema drops unknown fields of a JSON record and gives null for absent ones."""
    parsed = F.from_json(F.to_json(F.from_json("props", "k int, other string")), "k int, absent string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["absent"].alias("absent"))


@query("SELECT * FROM (VALUES ('de', 1.0::DOUBLE, 'epoch'), ('en', 2.0::DOUBLE, 'resampled')) AS t(name, weight, sampling)")
def spec_migration(spark, sf_dir):
    """Specs of an older version (``mix`` for weight) read through a migration."""
    from tessella.plans.specs import register_spec_migration

    register_spec_migration(1, lambda d: {("weight" if k == "mix" else k): v for k, v in d.items()})
    old = ['{"name": "de", "mix": 1.0, "unknown": 1}', '{"name": "en", "mix": 2.0, "shard_sampling": "resampled"}']
    specs = [DatasetSpec.from_dict(json.loads(x)) for x in old]
    return spark.createDataFrame([(s.name, s.weight, s.shard_sampling) for s in specs], "name string, weight double, sampling string")


@query("""SELECT event_id, '{"name":"' || event_type || '","cat":"event","ph":"X","ts":' || epoch_us(ts) || ',"dur":' || event_id % 1000 || ',"pid":' || user_id || ',"tid":0}' AS event FROM events""")
def trace_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return stats.trace_events(events, F.col("event_type"), F.lit("event"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 1000, F.col("user_id"), F.lit(0), "event_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def index_item_counts(spark, sf_dir):
    """An index file of 8-byte offsets is written per shard; its items are counted by its size alone."""
    folder = f"{scratch_folder(spark)}/index-{uuid.uuid4().hex}"
    for r in table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per shard
        tar.write_index(spark, f"{folder}/{r['source']}.idx", range(0, 512 * r["n"], 512))
    return tar.index_counts(spark, f"{folder}/*.idx").select(F.regexp_extract("path", r"([^/]+)\.idx$", 1).alias("source"), "n")


@query("SELECT user_id, count(*) AS batches, sum(value) AS busy_ms, max(ts) AS heartbeat FROM events GROUP BY user_id")
def metrics_block(spark, sf_dir):
    """Counters per rank from the metric log."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("value").alias("busy_ms"), F.max("ts").alias("heartbeat"))


@query("SELECT i % 64 AS pool_idx, count(*) AS n FROM (SELECT unnest(range(1000)) AS i) GROUP BY 1")
def synthetic_source(spark, sf_dir):
    """A fixed pool taken in turn."""
    return spark.range(1000).select((F.col("id") % 64).alias("pool_idx")).groupBy("pool_idx").agg(F.count(F.lit(1)).alias("n"))


def scratch_folder(spark) -> str:
    """The folder that driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
          WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Structured Streaming over the events: windows of a day that the watermark has closed."""
    found = windows.run_available(spark, f"{sf_dir}/events.parquet", scratch_folder(spark))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


# --- archives, pixels, masks; those without SQL twins are held against plain versions by tests ---------------------------------


def images(spark, sf_dir):
    """embeddings as 8 x 8 gray images: (vec_id, label, image, width, height)."""
    ship(spark)

    def draw(frames):
        for f in frames:
            data = [encode_png(np.clip(np.asarray(e, float)[:64].reshape(8, 8) * 32 + 128, 0, 255).astype(np.uint8)) for e in f["embedding"]]
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "image": data, "width": 8, "height": 8})

    return table(spark, sf_dir, "embeddings").mapInPandas(draw, "vec_id long, label int, image binary, width int, height int")


GRAY_SQL = "list_sum(list_transform(embedding[1:64], lambda x: trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, x::DOUBLE * 32 + 128)))))::BIGINT"
TAR_SQL = f"""SELECT (vec_id // 100)::VARCHAR AS shard_path, vec_id::VARCHAR AS key, {GRAY_SQL} AS gray,
              CASE WHEN vec_id % 3 = 0 THEN '{{"quality_score":' || label || '}}' END AS meta FROM embeddings"""


def scanned(archives: DataFrame, **options) -> DataFrame:
    """Samples with the sum of each decoded image's samples; images stay with the worker that decodes them."""
    return tar.extract(archives, with_image=False, measure=lambda pixels: int(pixels[:, :, 0].sum(dtype=np.int64)), **options).withColumnRenamed("measure", "gray")


def packed(spark, sf_dir) -> DataFrame:
    """Images packed into shards of 100 with sidecars for every third."""
    rows = images(spark, sf_dir).withColumn("meta", F.when(F.col("vec_id") % 3 == 0, F.to_json(F.struct(F.col("label").alias("quality_score")))))
    return tar.pack_shards(rows.withColumn("shard", F.floor(F.col("vec_id") / 100)), "shard", "vec_id", "image", "meta")


@query(f"SELECT *, row_number() OVER (PARTITION BY shard_path ORDER BY key) - 1 AS pos, NULL::VARCHAR AS error FROM ({TAR_SQL})")
def tar_scan(spark, sf_dir):
    """Shards read again: keys in archive order, the sum of each decoded image's samples, sidecars."""
    return scanned(packed(spark, sf_dir)).select("shard_path", "key", "pos", "gray", "meta", "error")


@query(f"SELECT *, row_number() OVER (PARTITION BY shard_path ORDER BY key) - 1 AS pos FROM ({TAR_SQL}) WHERE meta IS NOT NULL")
def tar_scan_required(spark, sf_dir):
    """The archive-stream rule: samples without a sidecar, or whose image can't be decoded, are left out."""
    return scanned(packed(spark, sf_dir), require_json=True, decodable=True).select("shard_path", "key", "pos", "gray", "meta")


@query()
def augment_multicrop(spark, sf_dir):
    fanned = views.fan_out(images(spark, sf_dir), views.view_table(spark, SMALL_CROPS))
    drawn = views.with_parameters(views.random_crop(fanned, "width", "height", "multicrop", "vec_id", "view"), SMALL_CROPS, "multicrop", "vec_id", "view")
    return pixels.augment_views(drawn, ["vec_id", "view", "name"], SMALL_CROPS.mean, SMALL_CROPS.std)


PIXEL_SQL = "trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, embedding[(y * 8 + x + 1)::INT]::DOUBLE * 32 + 128)))"


@query(f"""SELECT vec_id, 3 AS c, 7 AS h, 7 AS w, flatten(list_transform([[0.485, 0.229], [0.456, 0.224], [0.406, 0.225]]::DOUBLE[][], lambda s: flatten(list_transform(range(7), lambda y:
           list_transform(range(7), lambda x: (({PIXEL_SQL} / 255 - s[1]) / s[2])::FLOAT))))) AS data FROM embeddings""")
def augment_eval(spark, sf_dir):
    """An 8 x 8 image keeps its size; its central 7 x 7 square starts at its corner."""
    return pixels.eval_views(images(spark, sf_dir), ["vec_id"], EvalSpec(crop_size=7))


@query()
def augment_context_targets(spark, sf_dir):
    """A context with light augmentation, targets with crops alone."""
    spec = ContextTargetsSpec(context_crop_size=8, target_crop_size=4)
    none = MultiCropConfig(flip_prob=0.5, color_jitter_prob=0.8, grayscale_prob=0.0)
    fanned = views.fan_out(images(spark, sf_dir), spark.createDataFrame(views.context_rows(spec), views.VIEW_SCHEMA))
    drawn = views.with_parameters(views.random_crop(fanned, "width", "height", "context", "vec_id", "view"), none, "context", "vec_id", "view")
    first = F.col("view") == 0
    drawn = drawn.withColumn("flip", F.col("flip") & first).withColumn("jitter", F.col("jitter") & first)
    return pixels.augment_views(drawn, ["vec_id", "view", "name"], spec.mean, spec.std)


def halves(batch: np.ndarray) -> dict[str, np.ndarray]:
    """An example of a user's augmentation: the upper and the lower half."""
    h = batch.shape[2] // 2
    return {"upper": batch[:, :, :h], "lower": batch[:, :, h:]}


@query()
def user_aug(spark, sf_dir):
    return pixels.user_views(images(spark, sf_dir), "vec_id", UserSpec(fn=halves, views=("upper", "lower"), decode_size=8))


@query(f"SELECT vec_id, vec_id // {BATCH} AS batch_id, 196 AS n_patches, 75 AS n_masked, 1::BIGINT AS masks_in_batch FROM embeddings")
def block_masks(spark, sf_dir):
    """One mask per batch of images, attached to its samples: its size, and how many different masks a batch has."""
    batches = batching.with_batch(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", BATCH).select("vec_id", "batch_id")
    masks = masking.with_masks(batches, "batch_id", masking.BlockMasks(14, 14, 75), "masks")
    held = batches.join(masks, "batch_id").select("vec_id", "batch_id", "mask")
    per_batch = held.groupBy("batch_id").agg(F.count_distinct("mask").alias("masks_in_batch"))
    return held.join(per_batch, "batch_id").select("vec_id", "batch_id", F.size("mask").alias("n_patches"), F.size(F.filter("mask", lambda m: m)).alias("n_masked"), "masks_in_batch")


# --- the loader -------------------------------------------------------------------------------------------------------

EPOCH = 3


def loader_sql(epoch: int) -> str:
    """Batches of one epoch over the images, with four datasets by number: draws, pools and batches in SQL."""
    pool, mix = seed_text("pool", epoch=epoch), seed_text("mix", epoch=epoch)
    return f"""WITH s AS (SELECT vec_id, (vec_id % 4)::INT AS ds_idx, vec_id::VARCHAR AS key FROM embeddings),
        p AS (SELECT ds_idx, key, row_number() OVER (PARTITION BY ds_idx ORDER BY {uniform_sql(pool, 'ds_idx', 'key')}, key) AS k, count(*) OVER (PARTITION BY ds_idx) AS n FROM s),
        d AS (SELECT t, {cut_sql('u')} AS ds_idx FROM (SELECT t, {uniform_sql(mix, 't')} AS u FROM (SELECT unnest(range((SELECT count(*) // 16 * 16 FROM s))) AS t))),
        j AS (SELECT *, row_number() OVER (PARTITION BY ds_idx ORDER BY t) AS j FROM d)
        SELECT j.t // 16 AS batch_id, j.t % 16 AS slot, j.ds_idx, p.key FROM j JOIN p ON p.ds_idx = j.ds_idx AND p.k = (j.j - 1) % p.n + 1"""


def loader(spark, sf_dir, **options) -> SampleLoader:
    samples = images(spark, sf_dir).select((F.col("vec_id") % 4).cast("int").alias("ds_idx"), F.col("vec_id").cast("string").alias("key"), F.lit(None).cast("string").alias("meta"), "image")
    specs = [DatasetSpec(n, weight=w) for n, w in zip(LANGS, (0.2, 0.5, 0.1, 0.2))]
    return SampleLoader(spark, samples, specs, 16, aug=MultiCropSpec(SMALL_CROPS), rank=0, world_size=1, **options)


@query(f"SELECT *, 2 AS n_first, 4 AS n_rest, ['view_0', 'view_1'] AS names, 3 * 8 * 8 AS first_size, 3 * 4 * 4 AS rest_size, 20 AS n_masked FROM ({loader_sql(0)})")
def loader_batches(spark, sf_dir):
    """The whole loader: filtered pools, weighted draws, batches, views by the specification's type, split, masks."""
    rows = loader(spark, sf_dir).batches(masking.BlockMasks(8, 8, 20))
    names = F.transform("first", lambda v: v["name"])
    sizes = [F.size(F.col(c)[0]["data"]).alias(f"{c}_size") for c in ("first", "rest")]
    return rows.select("batch_id", "slot", "ds_idx", "key", F.size("first").alias("n_first"), F.size("rest").alias("n_rest"), names.alias("names"), *sizes, F.size(F.filter("mask", lambda m: m)).alias("n_masked"))


@query(loader_sql(EPOCH))
def loader_second_epoch(spark, sf_dir):
    """After a resumed epoch the next one is whole."""
    found = loader(spark, sf_dir)
    found.load_state(LoaderState(step=5, epoch=1, dataset_names=list(LANGS), mixing_weights=[0.2, 0.5, 0.1, 0.2], global_crop_size=8, local_crop_size=4))
    found.set_epoch(EPOCH)
    return found.pipeline().dataframe().select("batch_id", "slot", "ds_idx", "key")


@query(f"SELECT * FROM ({loader_sql(EPOCH)}) WHERE batch_id > 5")
def loader_resumed(spark, sf_dir):
    """What is left of an epoch after its step 5."""
    found = loader(spark, sf_dir)
    found.load_state(LoaderState(step=5, epoch=EPOCH, dataset_names=list(LANGS), mixing_weights=[0.2, 0.5, 0.1, 0.2], global_crop_size=8, local_crop_size=4))
    return found.pipeline().dataframe().select("batch_id", "slot", "ds_idx", "key")
