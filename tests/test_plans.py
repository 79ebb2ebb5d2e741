import time
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.telemetry import MetricsSink, StageTimer, span_table
from tessella.operators import mixing, sampling
from tessella.operators.numbering import bucket_of, numbered, quantiles
from tessella.plans.environment import Consumer
from tessella.plans.pipeline import Pipeline, SampleLoader
from tessella.plans.specs import ContextTargetsSpec, DatasetSpec, EvalSpec, LoaderConfig, LoaderState, MultiCropConfig, MultiCropSpec, UserSpec
from tessella.plans.weights import MixingWeights
from tessella.sources import cli, tar
from tessella.sources.checkpoint import Checkpointer, envelope, parse
from tessella.streaming import windows


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=8).filter(lambda w: sum(w) > 1e-3))
def test_weights_sum_to_one_and_intervals_tile(raw):
    w = MixingWeights.of([str(i) for i in range(len(raw))], raw)
    assert abs(sum(w.weights) - 1) < 1e-9
    spans = w.intervals()
    assert spans[0][0] == 0 and spans[-1][1] == 1.0
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(lo == hi for (lo, hi), x in zip(spans, w.weights) if x == 0)


def test_weights_reject():
    for names, raw in ((["a"], [0]), (["a", "b"], [1]), (["a", "b"], [-1, 2]), (["a", "a"], [1, 1])):
        with pytest.raises(ValueError):
            MixingWeights.of(names, raw)
    with pytest.raises(KeyError):
        MixingWeights.of(["a"], [1]).with_weight("b", 1)


def test_set_by_name_edits_the_normalised_vector():
    w = MixingWeights.of(["a", "b"], [5, 5]).with_weight("a", 3.0)
    assert w.weights == pytest.approx((3 / 3.5, 0.5 / 3.5))


def test_mix_stops_and_never_draws_weight_zero(spark):
    w = MixingWeights.of(["a", "b", "c"], [1, 0, 1])
    pool = spark.createDataFrame([(d, k, f"{d}-{k}") for d in (0, 2) for k in range(1, 6)], "ds_idx int, k long, key string")
    plan = mixing.draws(spark, 50, w, "s")
    rows = mixing.mix_until_exhausted(plan, pool).orderBy("t").collect()
    assert {r["ds_idx"] for r in rows} == {0, 2}
    assert [r["t"] for r in rows] == list(range(len(rows))) and 5 <= len(rows) <= 10
    assert mixing.mix_until_exhausted(mixing.draws(spark, 5, MixingWeights.of(["b"], [1]), "s"), pool.where("ds_idx = 9")).count() == 0
    cyc = mixing.mix_cyclic(plan, pool)
    assert cyc.count() == 50
    with pytest.raises(RuntimeError):
        mixing.require_pools(pool.where("ds_idx = 0"), w)


def test_ranks_partition_the_shards(spark):
    shards = spark.createDataFrame([("a", i) for i in range(10)], "ds string, shard_idx int")
    found = [r["shard_idx"] for k in range(3) for r in sampling.of_rank(shards, k, 3).collect()]
    assert sorted(found) == list(range(10))
    with pytest.raises(RuntimeError):
        sampling.of_rank(shards.where("shard_idx = 0"), 2, 3)


def test_weighted_permutation_is_a_bijection_with_zero_last(spark):
    df = spark.range(200).select("id", F.lit("x").alias("g"), (F.col("id") % 4).cast("double").alias("w"))
    rows = sampling.weighted_permutation(df, "seed", "id", "w", ["g"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, 201)) and len({r["id"] for r in rows}) == 200
    assert all(r["w"] == 0 for r in rows[150:])
    assert sum(r["w"] for r in rows[:50]) > sum(r["w"] for r in rows[100:150])


def test_block_shuffle_stays_in_blocks(spark):
    df = spark.range(100).select("id", F.lit(1).alias("g"))
    for r in sampling.block_shuffled(df, "s", "id", 16, ["g"]).collect():
        assert (r["pos"] - 1) // 16 == r["id"] // 16


def test_specs():
    assert MultiCropConfig(resolution_schedule=[(10, 64), (0, 32)]).crop_size_at_epoch(9) == 32
    assert MultiCropConfig(resolution_schedule=[(10, 64)]).crop_size_at_epoch(5) == 224
    assert MultiCropSpec().n_views == 10 and MultiCropSpec().supports_masking and not EvalSpec().supports_masking
    assert ContextTargetsSpec(n_target_views=2).view_names() == ["context", "target_0", "target_1"]
    assert UserSpec(fn=print, views=("a", "b", "c")).n_first == 1
    for bad in (lambda: MultiCropConfig(resolution_schedule=[(-1, 3)]), lambda: EvalSpec(interpolation="x"), lambda: ContextTargetsSpec(target_scale=(0.5, 0.2)), lambda: UserSpec(fn=None, views=("a",)), lambda: DatasetSpec("a", shard_sampling="x"), lambda: DatasetSpec("a", ("s",), shard_quality_scores=(1, 2))):
        with pytest.raises(ValueError):
            bad()
    spec = DatasetSpec("a", ("x", "y"), 2.0)
    assert DatasetSpec.from_dict(spec.to_dict() | {"later": 1}) == spec


@pytest.mark.parametrize("bad", [{"output_dtype": "x"}, {"stateful": True}, {"stall_timeout_s": -1}, {"heartbeat_stale_s": 0}, {"warn_utilisation": 2}, {"metrics_port": 0}, {"checkpoint_every_steps": 0}])
def test_loader_config_rejects(bad):
    with pytest.raises(ValueError):
        LoaderConfig(**bad)
    assert LoaderConfig.from_dict(LoaderConfig(seed=3).to_dict() | {"unknown": 1}).seed == 3


def test_checkpoints(spark, tmp_path):
    c = Checkpointer(spark, f"file://{tmp_path}/c", every=5)
    assert c.load() is None and c.save(LoaderState(step=3)) is None
    for epoch, step in ((0, 100), (0, 105), (0, 110), (1, 0), (1, 5)):
        assert c.save(LoaderState(step=step, epoch=epoch, dataset_names=["a"], mixing_weights=[1.0]))
    assert len(c.names()) == 3
    assert (c.load().epoch, c.load().step) == (1, 5)
    (tmp_path / "c" / "LATEST").unlink()
    assert c.load().step == 5
    text = envelope(LoaderState(step=7))
    assert parse(text).step == 7 and parse('{"step": 4, "other": 1}').step == 4
    with pytest.raises(ValueError):
        parse(text.replace('"step": 7', '"step": 8'))
    assert Checkpointer(spark, f"file://{tmp_path}/c", rank=1).save(LoaderState()) is None


def samples(spark, n=40):
    return spark.range(n).select((F.col("id") % 2).cast("int").alias("ds_idx"), (F.col("id") % 5).alias("shard_idx"), F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 4 == 0, F.lit('{"quality_score": 0.1}')).when(F.col("id") % 4 == 1, F.lit('{"quality_score": 0.9}')).alias("meta"))


def test_loader_plans_and_resumes(spark, tmp_path):
    specs = [DatasetSpec("a", min_sample_quality=0.5), DatasetSpec("b", weight=3.0)]
    loader = SampleLoader(spark, samples(spark), specs, 4, LoaderConfig(stateful=True, checkpoint_dir=f"file://{tmp_path}/l", checkpoint_every_steps=1))
    pipe = loader.pipeline()
    rows = pipe.dataframe().collect()
    assert len(rows) == len(pipe) * 4 and {r["slot"] for r in rows} == {0, 1, 2, 3}
    assert all(r["ds_idx"] == 1 or int(r["key"][1:]) % 4 for r in rows)
    again = SampleLoader(spark, samples(spark).repartition(7), specs, 4).pipeline().dataframe()
    key = lambda r: (r["batch_id"], r["slot"], r["key"])
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    loader.set_epoch(1)
    assert sorted(map(key, rows)) != sorted(map(key, loader.pipeline().dataframe().collect()))
    loader.set_weights([1, 1])
    loader.checkpoint(2)
    other = SampleLoader(spark, samples(spark), specs, 4, loader.config)
    assert other.resume() and other.weights.weights == (0.5, 0.5)
    left = other.pipeline().dataframe().collect()
    assert {r["batch_id"] for r in left} == {b for b in {r["batch_id"] for r in loader.pipeline().dataframe().collect()} if b > 2}
    with pytest.raises(ValueError):
        loader.set_resolution(500, 96)
    with pytest.raises(RuntimeError):
        SampleLoader(spark, samples(spark), specs, 4, predicate=F.col("ds_idx") == 0).pipeline()


def test_a_later_epoch_is_whole_and_states_round_trip(spark, caplog, monkeypatch):
    specs = [DatasetSpec("a"), DatasetSpec("b")]
    loader = SampleLoader(spark, samples(spark), specs, 4)
    whole = {r["batch_id"] for r in loader.pipeline().dataframe().collect()}
    loader.load_state(LoaderState(step=5, dataset_names=["a", "b"], mixing_weights=[0.5, 0.5]))
    pipe = loader.pipeline()
    assert {r["batch_id"] for r in pipe.dataframe().collect()} == {b for b in whole if b > 5} and len(pipe) == 4
    loader.set_epoch(0)
    assert loader.step == 5  # the same epoch goes on
    loader.set_epoch(1)
    assert {r["batch_id"] for r in loader.pipeline().dataframe().collect()} == whole
    assert loader.state().step == -1 and SampleLoader(spark, samples(spark), specs, 4).step is None
    state = loader.pipeline().with_epoch(3).state()
    other = SampleLoader(spark, samples(spark), specs, 4).pipeline().select(F.col("slot") == 0, "first").with_state(state)
    assert len(other) == 3 and other.loader.epoch == 1 and sorted(r["batch_id"] for r in other.dataframe().collect()) == [0, 1, 2]
    loader.load_state(LoaderState(epoch=7, dataset_names=["x", "b"], mixing_weights=[0.9, 0.1]))
    assert loader.epoch == 7 and loader.weights.weights == (0.5, 0.5) and "not restored" in caplog.text
    big = SampleLoader(spark, samples(spark), specs, 4, aug=MultiCropSpec(MultiCropConfig(resolution_schedule=[(0, 98), (2, 448)])))
    with pytest.raises(ValueError):
        big.set_epoch(2)


def test_one_iteration_at_a_time_and_empty_epochs(spark, monkeypatch):
    loader = SampleLoader(spark, samples(spark), [DatasetSpec("a"), DatasetSpec("b")], 4)
    batches = iter(loader)
    with pytest.raises(RuntimeError):
        iter(loader)
    assert [len(b) for b in batches] == [4] * 10
    assert len(next(iter(loader))) == 4
    started = iter(loader)
    with pytest.raises(RuntimeError):
        iter(loader)
    started.close()  # without a batch taken
    assert len(next(iter(loader))) == 4
    none = lambda **c: SampleLoader(spark, samples(spark), [DatasetSpec("a"), DatasetSpec("b")], 4, LoaderConfig(**c), predicate=F.lit(False))
    with pytest.raises(RuntimeError, match="no batch"):
        none().pipeline()
    assert none(stall_timeout_s=0).pipeline().dataframe().isEmpty()
    monkeypatch.setenv("TESSELLA_ALLOW_EMPTY_EPOCH", "1")
    assert len(none().pipeline()) == 0
    left = SampleLoader(spark, samples(spark), [DatasetSpec("a"), DatasetSpec("b")], 4, predicate=F.col("ds_idx") == 1, drop_empty=True)
    assert {r["ds_idx"] for r in left.pipeline().dataframe().collect()} == {1}


def test_pools_follow_the_sampling_of_their_dataset(spark, tmp_path):
    rows = samples(spark)
    order = lambda spec, **c: [r["key"] for r in SampleLoader(spark, rows, [spec, DatasetSpec("b")], 4, LoaderConfig(**c)).pool().where("ds_idx = 0").orderBy("k").collect()]
    keys = [f"k{i}" for i in range(0, 40, 2)]
    assert order(DatasetSpec("a", shard_sampling="sequential")) == sorted(keys, key=lambda k: (int(k[1:]) % 5, k))
    permuted, mixed, drawn = order(DatasetSpec("a")), order(DatasetSpec("a", shard_sampling="shuffle"), shuffle_buffer_size=4), order(DatasetSpec("a", shard_sampling="resampled"))
    assert sorted(permuted) == sorted(mixed) == sorted(keys) and [sorted(mixed[i : i + 4]) for i in range(0, 20, 4)] == [sorted(permuted[i : i + 4]) for i in range(0, 20, 4)]
    assert len(drawn) == 20 and set(drawn) < set(keys)
    scored = order(DatasetSpec("a", tuple("vwxyz"), shard_quality_scores=(1, 0, 1, 1, 1)))
    assert {k for k in scored[-4:]} == {"k6", "k16", "k26", "k36"}  # shard 1 has score 0
    log = SampleLoader(spark, rows, [DatasetSpec("a"), DatasetSpec("b")], 4, LoaderConfig(debug_log_keys=f"file://{tmp_path}/keys"))
    seen = [r["key"] for r in log.pipeline().dataframe().collect()]
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/keys").collect()) == sorted(seen)


def test_consumers_come_from_the_environment():
    assert Consumer.inferred({}) == Consumer(0, 1, 1)
    assert Consumer.inferred({"SLURM_PROCID": "3", "LOCAL_RANK": "1", "SLURM_NTASKS": "8", "LOCAL_WORLD_SIZE": "4"}) == Consumer(3, 8, 4)
    assert Consumer.inferred({"RANK": "2", "SLURM_PROCID": "3", "WORLD_SIZE": "5"}) == Consumer(2, 5, 1)


def test_metrics_and_stages(spark):
    sink = MetricsSink(spark, 2, clock=lambda: 77.9)
    sink.inc("batches")
    sink.inc("read_bytes", 500)
    sink.set_float("utilisation", 0.5)
    sink.heartbeat()
    for bad in (lambda: sink.inc("utilisation"), lambda: sink.set_float("batches", 1.0), lambda: sink.inc("x")):
        with pytest.raises(TypeError):
            bad()
    assert sink.counting("queue_depth", spark.range(30)).count() == 30
    ticks = iter([0, 5_000_000, 10_000_000, 12_000_000])
    timer = StageTimer("read", sink, clock=lambda: next(ticks))
    assert timer.stop() == 0 and timer.start().stop() == 5
    with pytest.raises(KeyError), timer:
        raise KeyError
    row = sink.table().first()
    assert (row["rank"], row["batches"], row["read_bytes"], row["utilisation"], row["heartbeat"], row["queue_depth"], row["read_ms"]) == (2, 1, 500, 0.5, 77, 30, 7)
    assert [r["duration_us"] for r in span_table(spark, timer.spans).collect()] == [5000, 2000]


def test_catalogue_commands(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = cli.add(spark, root, "public", "rgb", "set", "train")
    assert (tmp_path / "public/rgb/set/outputs/default/train").is_dir() and (tmp_path / "public/rgb/set/raw").is_dir()
    for k in range(2):
        tar.write_index(spark, f"{made}/outputs/default/train/shard-{k:06d}.idx", range(0, 512 * 8, 512))
        (tmp_path / f"public/rgb/set/outputs/default/train/shard-{k:06d}.tar").write_bytes(b"x")
    assert cli.count(spark, root, "set").collect()[0].asDict() == {"dataset": "set", "strategy": "default", "split": "train", "n": 16}
    assert [r["n_shards"] for r in cli.preview(spark, root).collect()] == [2]
    assert cli.main(["x"]) == 2


def test_numbers_are_exact_over_many_buckets(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") * 7919 % 1_000_003).alias("k"), (F.col("id") % 3).alias("g"), "id")
    rows = numbered(df, "n", [F.col("k"), F.col("id")], F.col("k"), ["g"], rows=100).collect()
    for g in range(3):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["k"], r["id"]))
        assert [r["n"] for r in mine] == list(range(1, 1001))
    wide = spark.range(20000).select((F.col("id") * 1_000_003).alias("k"))  # sparse keys
    buckets = [r["count"] for r in wide.select(bucket_of(F.col("k").cast("double"), quantiles(wide, F.col("k"), 50)).alias("b")).groupBy("b").count().collect()]
    assert len(buckets) == 50 and max(buckets) < 2 * 400
    many = spark.range(5000).select(F.exp(F.col("id") / 300).alias("ms"))  # values far above 1000
    assert max(r["count"] for r in many.select(bucket_of(F.col("ms"), quantiles(many, F.col("ms"), 20)).alias("b")).groupBy("b").count().collect()) < 2 * 250
    assert bucket_of(F.col("ms"), []) is not None and quantiles(many.where("false"), F.col("ms"), 5) == []


def test_late_rows_are_dropped_and_closed_windows_written_once(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    at = lambda d, h: datetime(2024, 1, d, h)
    for k, rows in enumerate([[(1, at(1, 5), "a", 1.0), (2, at(3, 5), "a", 2.0)], [(4, at(3, 6), "a", 3.0)], [(3, at(1, 6), "a", 50.0)], [(5, at(5, 2), "a", 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/p{k}")
        (part,) = (tmp_path / f"p{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{k}.parquet")
        time.sleep(1.1)  # files are read in the order of their times
    found = windows.run_available(spark, f"file://{tmp_path}/in", f"file://{tmp_path}", files_per_batch=1)
    assert sorted((r["start"].day, r["n"], r["total"]) for r in found.collect()) == [(1, 1, 1.0), (3, 2, 5.0)]


def test_pipeline_composition(spark):
    base = spark.range(40).select(F.floor(F.col("id") / 2).alias("batch_id"), "id")
    p = Pipeline(base, length=20)
    assert len(p) == 20 and len(p.with_epoch(3)) == 3
    even = p.with_epoch(9).select(F.col("batch_id") % 2 == 0).with_epoch(3)
    assert sorted({r["batch_id"] for r in even.dataframe().collect()}) == [0, 2, 4]
    assert p.steps == ()
    assert p.select(F.col("id") < 10, "low").skipped().first()["n_skipped"] == 30
    with pytest.raises(TypeError):
        len(Pipeline(base))
