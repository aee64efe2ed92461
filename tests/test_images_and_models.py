"""Stored images and models, regions of pixels, joint k-means."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliper.operators import ml
from caliper.operators.rasters import largest_region, mask_runs, pixel_rows, red_run_keep, regions
from caliper.sources import images as im
from caliper.sources import models as mo
from caliper.sources.scratch import scratch_path


def png(pixels, filters):
    """A PNG whose row y is filtered by filters[y], by the definition of the five filters."""
    h, w, bands = pixels.shape
    rows = pixels.reshape(h, -1).astype(int)
    body = b""
    for y in range(h):
        line = []
        for i, v in enumerate(rows[y]):
            a = rows[y][i - bands] if i >= bands else 0
            b = rows[y - 1][i] if y else 0
            c = rows[y - 1][i - bands] if y and i >= bands else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, paeth][filters[y]]) % 256)
        body += bytes([filters[y], *line])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    z = zlib.compress(body)
    return im.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", z[:9]) + chunk(b"IDAT", z[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png_filters(bands):
    rng = np.random.default_rng(bands)
    for _ in range(10):
        x = rng.integers(0, 256, (7, int(rng.integers(1, 9)), bands)).astype(np.uint8)
        assert np.array_equal(im.decode_png(png(x, rng.integers(0, 5, 7))), x) and np.array_equal(im.decode_png(im.encode_png(x)), x)


def test_damaged_pngs():
    good = im.encode_png(np.zeros((2, 2, 3), np.uint8))
    for bad in (b"", b"GIF89a", good[:20] + b"\xff" + good[21:], good.replace(b"IDAT", b"IDAX")):
        with pytest.raises((ValueError, zlib.error)):
            im.decode_png(bad)


def images_table(spark, n):
    side = F.col("image_id") % 5 + 1
    cells = F.transform(F.sequence(F.lit(1), side * side * 3), lambda i: F.lpad(F.hex((i * 37 + F.col("image_id")) % 256), 2, "0"))
    return spark.range(n).withColumnRenamed("id", "image_id").select("image_id", side.cast("int").alias("height"), side.cast("int").alias("width"), F.lit(3).alias("bands"), F.unhex(F.array_join(cells, "")).alias("pixels"))


def test_images_round_trip_by_byte_ranges(spark):
    path, df = scratch_path(spark, "images"), images_table(spark, 300)
    im.write_images(df.repartition(3), path)
    got = im.read_images(spark, path, range_bytes=4000)
    assert got.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_pruning_and_filters_reach_the_source(spark):
    path = scratch_path(spark, "images")
    im.write_images(images_table(spark, 100).repartition(2), path)
    few = im.read_images(spark, path, ("image_id", "width")).where("image_id >= 90 and width in (2, 3) and image_id % 2 = 0")
    text = few._jdf.queryExecution().executedPlan().toString() + few._sc._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(image_id,90)" in text and "ReadSchema: struct<image_id:bigint,width:int>" in text
    assert {r["image_id"] for r in few.collect()} == {i for i in range(90, 100, 2) if i % 5 + 1 in (2, 3)}


def test_a_failed_write_leaves_nothing(spark):
    path = scratch_path(spark, "images")
    df = images_table(spark, 40).repartition(4)
    fails = df.withColumn("pixels", F.when(F.col("image_id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("pixels")))
    with pytest.raises(Exception, match="broken"):
        im.write_images(fails, path)
    with pytest.raises(Exception, match="no committed images"):
        im.read_images(spark, path).count()
    local = path.removeprefix("file://")
    assert not os.path.exists(f"{local}/{im.MANIFEST}")  # a killed task may still leave a part that nothing names
    im.write_images(df, path)
    with pytest.raises(Exception, match="broken"):
        im.write_images(fails, path, overwrite=True)
    assert im.read_images(spark, path).count() == 40
    with pytest.raises(Exception, match="already exists"):
        im.write_images(df, path)
    im.write_images(df.where("image_id < 7"), path, overwrite=True)
    assert im.read_images(spark, path).count() == 7 and len(os.listdir(local)) == 2  # the manifest and one job's parts


def test_no_images(spark):
    path = scratch_path(spark, "images")
    im.write_images(images_table(spark, 3).where("image_id > 5"), path)
    assert im.read_images(spark, path).count() == 0


def flood(mask):
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in seen:
                stack, own = [(y, x)], []
                seen.add((y, x))
                while stack:
                    a, b = stack.pop()
                    own.append((a, b))
                    for c in range(max(a - 1, 0), min(a + 2, h)):
                        for d in range(max(b - 1, 0), min(b + 2, w)):
                            if mask[c, d] and (c, d) not in seen:
                                seen.add((c, d))
                                stack.append((c, d))
                ys, xs = [a for a, _ in own], [b for _, b in own]
                out.append((y, x, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    return out


def test_regions_against_flood_fill(spark):
    rng = np.random.default_rng(1)
    masks = [rng.random((int(rng.integers(1, 20)), w)) < p for w in (1, 7, 64, 65, 200) for p in (0.1, 0.35, 0.6, 1.0)]
    spiral = np.zeros((40, 150), bool)
    spiral[::4], spiral[2::4, :1], spiral[1::8, -1:], spiral[3::8, -1:] = True, True, True, True
    masks.append(spiral)
    rows = [(i, m.astype(int).reshape(-1).tolist(), m.shape[1]) for i, m in enumerate(masks)]
    runs = None
    for i, values, width in rows:
        part = mask_runs(pixel_rows(spark.createDataFrame([(i, values)], "image int, p array<int>"), "image", "p", width), "image", "p", lambda v: v > 0)
        runs = part if runs is None else runs.unionByName(part)
    runs = runs.repartition(8).persist()
    got = sorted(map(tuple, regions(runs, "image").collect()))
    assert got == sorted((i, *r) for i, m in enumerate(masks) for r in flood(m))
    best = {r["image"]: tuple(r)[1:] for r in largest_region(runs, "image", 4).collect()}
    for i, m in enumerate(masks):
        found = sorted(flood(m), key=lambda r: (-r[6], r[0], r[1]))
        assert best.get(i) == (found[0][2:] if found and found[0][6] >= 4 else None)


def test_red_pixels(spark):
    rows = spark.createDataFrame([(1, 0, [(200, 10, 10), (200, 90, 10), None, (201, 9, 9)]), (1, 1, []), (2, 0, None)], "image int, y int, p array<struct<r:int,g:int,b:int>>")
    assert sorted(map(tuple, mask_runs(rows, "image", "p", red_run_keep(150, 50)).collect())) == [(1, 0, 0, 0), (1, 0, 3, 3)]


def test_models_score_alike_after_storing(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in rng.normal(i % 3, 1, 8)]) for i in range(300)], "id int, v array<float>")
    model, pca = ml.fit_kmeans(df, "v", 5, F.col("id")), ml.fit_pca_2d(df, "v")
    path = scratch_path(spark, "model")
    mo.save_model(mo.tensor_table(spark, {"centers": model.centers, "components": pca.components, "mean": pca.mean}), {"kind": "both", "k": 5}, path)
    config, back = mo.load_model(spark, path)
    assert config == {"kind": "both", "k": 5} and all(np.array_equal(a, b) for a, b in ((back["centers"], model.centers), (back["components"], pca.components), (back["mean"], pca.mean)))
    labels = lambda c: [r["cluster"] for r in ml.with_nearest_center(df, "v", c).orderBy("id").collect()]
    assert labels(back["centers"]) == labels(model.centers)
    points = lambda p: np.array([[r["pc1"], r["pc2"]] for r in ml.projected(df, "v", p).orderBy("id").collect()])
    stored = points(ml.Projection(back["components"], back["mean"]))
    assert np.array_equal(stored, points(pca)) and np.allclose(np.abs(stored), np.abs([[r["pc1"], r["pc2"]] for r in ml.pca_2d(df, "v").orderBy("id").collect()]), atol=1e-6)


def test_a_broken_model_is_not_there(spark):
    path = scratch_path(spark, "model")
    rows = spark.createDataFrame([("a", [2], [1.0, 2.0]), ("b", [3], [1.0])], mo.SCHEMA).repartition(2)
    with pytest.raises(Exception, match="tensor b has 1 values"):
        mo.save_model(rows, {}, path)
    with pytest.raises(FileNotFoundError):
        mo.load_model(spark, path)
    mo.save_model(rows.where("name = 'a'"), {"v": 1}, path)
    with pytest.raises(Exception, match="tensor b has 1 values"):
        mo.save_model(rows, {"v": 2}, path, overwrite=True)
    assert mo.load_model(spark, path)[0] == {"v": 1}
    mo.save_model(rows.where("name = 'a'"), {"v": 3}, path, overwrite=True)
    config, tensors = mo.load_model(spark, path)
    assert config == {"v": 3} and tensors["a"].tolist() == [1.0, 2.0]
    first = next(f for f in os.scandir(path.removeprefix("file://")) if f.is_dir())
    part = open(next(os.scandir(first.path)).path, "rb").read()
    assert part == b'{"name": "a", "shape": [2]}\n' + struct.pack("<dd", 1.0, 2.0)


def plain_kmeans(rows, k, seed, steps):
    """Lloyd in integers from the k rows first in a seeded order."""
    import hashlib

    x = np.floor(np.array([v for _, v in rows]) * ml.UNITS)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{seed}|{rows[i][0]}".encode()).hexdigest(), rows[i][0]))
    c = x[order[:k]]
    assign = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(steps):
        own = assign().argmin(axis=1)
        c = np.array([np.floor(x[own == j].sum(axis=0) / (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
    return int(assign().min(axis=1).sum()), c


def test_joint_kmeans_equals_single_fits(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(4 * (i % 4), 1), rng.gauss(0, 1), rng.gauss(i % 2, 1)]) for i in range(500)] + [(i, [9.0, 9.0, 9.0]) for i in range(500, 560)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    model = ml.fit_kmeans(df, "v", 7, F.col("id"), n_init=4, steps=12)
    singles = [plain_kmeans(rows, 7, 42 + i, 12) for i in range(4)]
    assert model.costs == [cost for cost, _ in singles] and model.cost == min(model.costs)
    assert np.array_equal(model.centers, min(singles, key=lambda s: s[0])[1])


def test_kmeans_with_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id int, v array<double>")
    assert {r["cluster"] for r in ml.kmeans_labels(df, "v", 9, F.col("id")).collect()} == {0, 1}
    with pytest.raises(ValueError):
        ml.fit_kmeans(df.limit(0), "v", 9, F.col("id"))
