"""Progressive JPEG, and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import time
import zlib

import jpeg_writer
import numpy as np
import pytest
import reference
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import common, jpeg, langid, media, mixing, quality, sp_maxplus

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("factors", [[(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3, [(1, 1)]])
def test_general_progressive(factors: list[tuple[int, int]]) -> None:
    rng = np.random.default_rng(3)
    for width, height in ((37, 21), (16, 16), (65, 9)):
        data, planes, quant = jpeg_writer.random_image(rng, width, height, factors)
        image = jpeg.decode(data)
        for c, p in zip(image.components.values(), planes, strict=True):
            assert (c.coefficients.reshape(p.shape) == p).all()
        rgb = np.concatenate(list(jpeg.rows_of_rgb(image)))
        want = jpeg_writer.pixels(planes, quant, factors, width, height)
        assert rgb.shape == (height, width, 3) and np.abs(rgb.astype(int) - want).max() <= 1


@pytest.mark.parametrize("factors", [[(3, 3), (2, 2), (1, 1)], [(2, 2), (1, 2), (2, 1)], [(4, 1), (3, 1), (1, 1)]])
def test_odd_sampling(factors: list[tuple[int, int]]) -> None:
    """Each sample of a component stands for the pixels that its place covers, also where the factors don't divide."""
    data, planes, _ = jpeg_writer.random_image(np.random.default_rng(4), 50, 41, factors)
    image = jpeg.decode(data)
    rgb = np.concatenate(list(jpeg.rows_of_rgb(image)))
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    full = []
    for c in image.components.values():
        grey = jpeg.Image(8 * c.stride, 8 * len(c.coefficients) // c.stride, {1: jpeg.Component(1, 1, c.table, c.stride, 0, c.stride, c.coefficients)}, image.quantisation)
        square = np.empty((len(c.coefficients), 64))
        square[:, jpeg.ZIGZAG] = c.coefficients * image.quantisation[c.table]
        samples = np.einsum("ux,buv,vy->bxy", jpeg._COSINE, square.reshape(-1, 8, 8), jpeg._COSINE) + 128
        plane = samples.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(grey.height, grey.width)
        full.append([[plane[y * c.v // most_v, x * c.h // most_h] for x in range(50)] for y in range(41)])
    y, cb, cr = map(np.array, full)
    want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
    assert rgb.shape == (41, 50, 3) and np.abs(rgb - np.clip(np.rint(want), 0, 255)).max() <= 1


def test_broken_media(spark) -> None:
    """Images that can't be read have nulls and say why; the others of their task are read."""
    good, _, _ = jpeg_writer.random_image(np.random.default_rng(5), 40, 24, [(2, 2), (1, 1), (1, 1)])
    payload = jpeg.encode_payload(b"x" * 192)
    frame = good.index(b"\xff\xc2")
    four = good[: frame + 9] + b"\x04" + good[frame + 10 :]
    filled = good[:2] + b"\xff\xff\xff" + good[2:]
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[: len(good) // 2]), (6, four), (7, filled), (8, payload), (9, good[:-2]), (10, b"\xff\xd8\xff\xd9"), (11, good)]
    images = spark.createDataFrame([(i, 0, m, 3.0) for i, m in rows], "doc_id long, n_bytes long, media binary, rgb double")
    got = {r["doc_id"]: r for r in media.rgb_tensors(images).collect()}
    assert len(got) == len(rows)
    for i, m in rows:
        r = got[i]
        if i in (1, 7, 8, 11):
            assert r["error"] is None and len(r["rgb"]) == 3 * r["height"] * r["width"]
        else:
            assert r["rgb"] is r["height"] is r["width"] is None and (r["error"] is None) == (m is None)
    assert got[1]["rgb"] == got[7]["rgb"]
    found = {r["doc_id"]: r for r in media.media_features(images).collect()}
    assert found[8]["payload_bytes"] == 192 and found[1]["payload_bytes"] is None and found[1]["feature"] and found[2]["media_bytes"] is None and found[5]["feature"] is None


def test_damaged_images_never_raise() -> None:
    """Thousands of images of which a few bytes are changed, cut or repeated: each is read or gives an error, and none asks for much memory."""
    rng = np.random.default_rng(17)
    whole = [jpeg_writer.random_image(rng, 24, 16, [(1, 1)])[0], jpeg_writer.random_image(rng, 40, 24, [(2, 2), (1, 1), (1, 1)])[0], jpeg.encode_payload(b"some text!!!" * 64)]
    errors = 0
    for k in range(6000):
        data = bytearray(whole[k % 3])
        for _ in range(rng.integers(1, 5)):
            data[rng.integers(len(data))] = rng.integers(256)
        if k % 7 == 0:
            at = rng.integers(len(data))
            data[at : at + rng.integers(1, 30)] = data[: rng.integers(0, 30)]
        image, rgb, error = media._tensor(bytes(data))
        facts = media._payload_facts(bytes(data), image)
        assert (rgb is None) == (error is not None) and (rgb is None or rgb.size <= 64 * 8 * len(data) * 16) and facts[3] == len(data)
        errors += error is not None
    assert 500 < errors < 6000
    huge = bytearray(whole[1])
    at = huge.index(b"\xff\xc2")
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    assert media._tensor(bytes(huge))[2] is not None
    scans = bytes(whole[1])
    start = scans.index(b"\xff\xda")
    assert "scan" in media._tensor(scans[:start] + b"\xff\xd9")[2]


def test_ordinary_image_is_read_fast() -> None:
    data, _, _ = jpeg_writer.random_image(np.random.default_rng(6), 640, 480, [(2, 2), (1, 1), (1, 1)])
    start = time.process_time()
    image = jpeg.decode(data)
    assert sum(c.coefficients.size for c in image.components.values()) / (time.process_time() - start) > 100_000


def test_zigzag() -> None:
    assert list(jpeg.ZIGZAG[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[-1] == 63


def test_payload_round_trip(monkeypatch) -> None:
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, jpeg.ROW + 3):
        payload = rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
        data = jpeg.encode_payload(payload)
        assert jpeg.payload_of(jpeg.decode(data)) == payload
        if n < 10:  # symbol by symbol gives the same
            with monkeypatch.context() as m:
                m.setattr(jpeg, "_uniform", lambda *a: False)
                assert jpeg.payload_of(jpeg.decode(data)) == payload


def test_media_in_spark(spark, odd) -> None:
    rows = media.media_features(common.staged(media.text_media(odd), "media-test")).collect()
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    want = []
    for doc, text in texts:
        n, payload = media.padded(text)
        want.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
    assert len({r["feature"] for r in rows if r["doc_id"] == 1}) == 1
    images = media.text_media(odd).union(spark.createDataFrame([(9, 0, None)], "doc_id long, n_bytes long, media binary"))
    tensors = media.rgb_tensors(images).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in tensors if r["media"] is not None) and [r["rgb"] for r in tensors if r["media"] is None] == [None]
    assert media.media_features(media.text_media(odd.where("false"))).count() == 0


def test_pipeline(spark) -> None:
    documents, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "tokenize":
            assert docs.columns == documents.columns
        if name == "language_id":
            assert {r["doc_id"] for r in kept[name]} == {r["doc_id"] for r in before.collect() if any(map(str.isalpha, r["text"] or ""))}
        elif name == "quality_classifier":
            good = {r["doc_id"] for r in quality.classify(before, labels).where("kept").collect()}
            assert {r["doc_id"] for r in kept[name]} == good
        elif name == "near_dedup":
            found = reference.near_duplicates([(r["doc_id"], r["text"]) for r in before.collect()], 5)
            assert {r["doc_id"] for r in kept[name]} == {i for i, (_, c) in found.items() if i == c}
        elif name == "mix_sources":
            times = {r["doc_id"]: r["times"] for r in mixing.mix(before, labels).collect()}
            counts: dict[int, int] = {}
            for r in kept[name]:
                counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
            assert counts == {i: n for i, n in times.items() if n}
    texts = {r["doc_id"]: r["text"] for r in kept["mix_sources"]}
    back = sp_maxplus.decode(docs.select("doc_id", "ids"), langid.default_tokenizer()).collect()
    assert len(back) == len(kept["mix_sources"]) and all(texts[r["doc_id"]] == r["text"] for r in back)
    assert corpus_pipeline.run(spark, SF).count() == len(back)


def test_pipeline_mixes_by_quality(spark) -> None:
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    taken = {r["doc_id"]: r["times"] for r in mixing.mix(docs, labels).collect() if r["times"]}
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
    assert {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect() if r["times"]} != taken


def test_stages_take_odd_rows(spark, odd, tmp_path) -> None:
    odd.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd.withColumn("n_chars", F.length("text").cast("long")), odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).collect()
