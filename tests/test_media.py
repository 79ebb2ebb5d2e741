import io
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella import queries as core
from tessella.operators import masking, pixels
from tessella.plans.specs import EvalSpec, UserSpec
from tessella.sources import tar
from tessella.sources.images import decode_image, decode_png, encode_png
from tests.conftest import DATA


@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 2**32 - 1))
def test_masks_are_exact(h, w, seed):
    target = np.random.default_rng(seed).integers(0, h * w + 1)
    spec = masking.BlockMasks(h, w, int(target), min_area=0)
    assert spec.draw(str(seed)).sum() == target


def test_masks_reject_and_repeat():
    with pytest.raises(ValueError):
        masking.BlockMasks(4, 4, 17)
    with pytest.raises(ValueError):
        masking.BlockMasks(4, 4, 8, min_area=9)
    m = masking.BlockMasks(14, 14, 75)
    a, b, c = (m.draw(k) for k in ("s:1", "s:1", "s:2"))
    assert (a == b).all() and (a != c).any() and a.shape == (14, 14)


@settings(max_examples=30)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 99))
def test_png_round_trip(h, w, color, seed):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if color else (h, w), dtype=np.uint8)
    found = decode_png(encode_png(img))
    assert (found == (img if color else np.repeat(img[:, :, None], 3, axis=2))).all()


def test_png_rejects():
    for data in (None, b"", b"\xff\xd8" + b"\0" * 99, encode_png(np.zeros((3, 3), np.uint8))[:40]):
        assert decode_png(data) is None


def test_pixel_operations():
    img = np.random.default_rng(0).integers(0, 256, (20, 30, 3)).astype(float)
    assert np.allclose(pixels.crop_resize(img, 0, 0, 20, 30, 20, 30), img)
    assert np.allclose(pixels.crop_resize(np.full((9, 9, 3), 77.0), 2, 1, 5, 6, 16, 4), 77)
    assert pixels.crop_resize(img, 3, 4, 10, 10, 5, 5).shape == (5, 5, 3)
    assert np.allclose(pixels.blurred(np.full((6, 6, 3), 9.0), 1.5), 9)
    assert np.allclose(pixels.jitter(img, 1, 1, 1, 0), img)
    assert np.ptp(pixels.jitter(img, 1, 1, 0, 0), axis=2).max() < 1e-9
    assert (pixels.solarized(np.array([0.0, 127, 128, 255])) == [0, 127, 127, 0]).all()
    t = pixels.to_tensor(img, (0.5,) * 3, (0.25,) * 3)
    assert t.shape == (3, 20, 30) and np.allclose(t[0], (img[:, :, 0] / 255 - 0.5) / 0.25, atol=1e-6)
    half = pixels.to_tensor(img, (0.5,) * 3, (0.25,) * 3, "bf16")
    assert np.abs(half - t).max() < 0.01 and not (half.view(np.uint32) & 0xFFFF).any()
    assert pixels.centred(img, 16, 14, (0.5,) * 3, (0.25,) * 3).shape == (3, 14, 14)


def archive(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_tar_pairs_sidecars(spark, tmp_path):
    good = archive([("a.jpg", b"1"), ("a.json", b'{"x": 1}'), ("b.png", b"2"), ("c.txt", b"3"), ("d.json", b"{}"), ("e/f.jpeg", b"4")])
    (tmp_path / "shard-000000.tar").write_bytes(good)
    rows = {r["key"]: r for r in tar.read_tar(spark, f"file://{tmp_path}/*.tar").collect()}
    assert set(rows) == {"a", "b", "e/f"} and rows["a"]["meta"] == '{"x": 1}' and rows["b"]["meta"] is None and bytes(rows["e/f"]["image"]) == b"4"
    df = spark.createDataFrame([("p", good), ("q", good[:700]), ("r", b""), ("s", b"junk" * 300)], "path string, content binary")
    assert {r["key"] for r in tar.extract(df.where("path = 'p'"), require_json=True).collect()} == {"a"}
    assert all(r["image"] is None for r in tar.extract(df.where("path = 'p'"), with_image=False).collect())
    found = tar.extract(df).collect()
    assert sum(r["error"] is not None for r in found if r["shard_path"] in ("r", "s")) == 2
    with pytest.raises(Exception):
        tar.extract(df.where("path = 's'"), on_error="fail").collect()
    (tmp_path / "shard-000000.idx").write_bytes(b"\0" * 24)
    assert tar.index_counts(spark, f"file://{tmp_path}/*.idx").first()["n"] == 3


def test_tar_samples_come_in_small_batches():
    blob = np.random.default_rng(0).bytes(1 << 20)
    data = archive([(f"{k:03d}.{kind}", blob if kind == "jpg" else b"{}") for k in range(30) for kind in ("jpg", "json")])
    given_rows = pa.RecordBatch.from_pydict({"path": ["p", "q"], "content": [data, data]})
    for with_image in (True, False):
        found = list(tar.sample_batches([given_rows], with_image=with_image))
        assert max(b.nbytes for b in found) <= tar.BATCH_BYTES + (2 << 20)
        rows = pa.Table.from_batches(found).select(["shard_path", "key", "pos", "meta"]).to_pylist()
        assert rows == [{"shard_path": p, "key": f"{k:03d}", "pos": k, "meta": "{}"} for p in "pq" for k in range(30)]


def test_tar_measures_images_where_they_are_decoded(spark):
    good = archive([("a.png", encode_png(np.full((2, 3), 7, np.uint8))), ("a.json", b"{}"), ("b.png", b"no image"), ("b.json", b"{}"), ("c.png", encode_png(np.full((1, 1), 9, np.uint8)))])
    df = spark.createDataFrame([("p", good), ("q", b"junk" * 300)], "path string, content binary")
    assert {(r["shard_path"], r["key"], r["pos"], r["gray"], r["image"]) for r in core.scanned(df).collect()} == {("p", "a", 0, 42, None), ("p", "b", 1, None, None), ("p", "c", 2, 9, None), ("q", None, 0, None, None)}
    assert [(r["key"], r["pos"], r["gray"]) for r in core.scanned(df.where("path = 'p'"), require_json=True, decodable=True).collect()] == [("a", 0, 42)]
    assert [r["key"] for r in tar.extract(df.where("path = 'p'"), with_image=False, decodable=True).collect()] == ["a", "c"]


@pytest.mark.parametrize("name", ["tar_scan", "tar_scan_required"])
def test_tar_scans_take_two_workers_a_task(spark, name):
    plan = core.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


@pytest.mark.parametrize("name, views", [("augment_multicrop", 6), ("augment_context_targets", 5), ("augment_eval", 1), ("user_aug", 2)])
def test_augmentations(spark, name, views):
    df = core.queries()[name](spark, f"{DATA}/sf0.001")
    n = core.table(spark, f"{DATA}/sf0.001", "embeddings").count()
    assert df.count() == n * views
    assert df.where("size(data) <> c * h * w OR c <> 3").count() == 0


def test_undecodable_becomes_zeros(spark):
    from tessella.plans.specs import EvalSpec

    df = spark.createDataFrame([(1, b"no image"), (2, None)], "k int, image binary")
    for r in pixels.eval_views(df, ["k"], EvalSpec(crop_size=3)).collect():
        assert not any(r["data"]) and r["h"] == 3
    bad = UserSpec(fn=lambda b: {"x": b}, views=("x", "y"), decode_size=2)
    with pytest.raises(Exception, match="missing"):
        pixels.user_views(df, "k", bad).collect()


def jvm_jpeg(spark, img, progressive=False, quality=0.9):
    """A JPEG written by the JVM's own writer (4:2:0 for colours), and the pixels that its reader gives."""
    jvm = spark.sparkContext._jvm
    h, w = img.shape[:2]
    gray = img.ndim == 2
    picture = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(img[y, x]),) * 3 if gray else map(int, img[y, x])
            if gray:
                picture.getRaster().setSample(x, y, 0, r)
            else:
                picture.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), param)
    stream.close()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    pixels_ = [[back.getRaster().getSample(x, y, 0) if gray else back.getRGB(x, y) for x in range(w)] for y in range(h)]
    a = np.array(pixels_, np.int64)
    return data, np.repeat(a[:, :, None], 3, axis=2) if gray else np.stack([a >> 16 & 255, a >> 8 & 255, a & 255], axis=2)


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_equals_the_jvms_decoder(spark, progressive):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:21, :35]
    smooth = np.stack([6 * x, 8 * y, 255 - 3 * x - 3 * y], axis=2).clip(0, 255)
    for img in (smooth, np.full((8, 8, 3), 90), smooth[:, :, 0], (smooth[:, :, 1] + rng.integers(0, 40, (21, 35))).clip(0, 255)):
        data, want = jvm_jpeg(spark, img, progressive)
        got = decode_image(data)
        assert got.shape == want.shape
        off = np.abs(got.astype(int) - want)
        assert off.max() <= (2 if img.ndim == 2 else 40) and off.mean() < (0.5 if img.ndim == 2 else 4)  # chroma is enlarged in another way


def test_jpeg_rejects(spark):
    data, _ = jvm_jpeg(spark, np.arange(256).reshape(16, 16))
    assert decode_image(b"\xff\xd8" + bytes(256) + b"\xff\xd9") is None and decode_image(data[:100]) is None and decode_image(None) is None
    assert decode_image(data[:-30]) is None  # a truncated file counts as undecodable
    rows = spark.createDataFrame([("a", archive([("k.jpg", data), ("l.jpg", b"\xff\xd8no")]))], "path string, content binary")
    views = {r["key"]: r for r in pixels.eval_views(tar.extract(rows), ["key"], EvalSpec(crop_size=7)).collect()}
    assert any(views["k"]["data"]) and not any(views["l"]["data"])
