"""Containers, records, states, positions, colours, encoders and pictures of products, against plain Python."""

import colorsys
import csv
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import analysis, containers, encoders, images, search
from lumenlake.sources import io, records


def png(path, x):
    h, w = x.shape[:2]
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in x)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


# --- positions and colours


def turned_by_loops(x, degrees, cubic, grow, fill=255.0):
    h, w, _ = x.shape
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    oh, ow = h, w
    if grow:
        # Corners of the source, turned about its centre.
        xs, ys = zip(*[((px - w / 2) * c + (py - h / 2) * s + w / 2, -(px - w / 2) * s + (py - h / 2) * c + h / 2) for px in (0, w) for py in (0, h)])
        near = lambda v: round(v, 9)
        ow, oh = int(np.ceil(near(max(xs))) - np.floor(near(min(xs)))), int(np.ceil(near(max(ys))) - np.floor(near(min(ys))))

    def kernel(d):
        d = abs(d)
        if not cubic:
            return max(0.0, 1 - d)
        if d <= 1:
            return d**3 - 2 * d**2 + 1
        return -(d**3) + 5 * d**2 - 8 * d + 4 if d < 2 else 0.0

    out = np.full((oh, ow, 3), fill)
    for i in range(oh):
        for j in range(ow):
            dx, dy = j + 0.5 - ow / 2, i + 0.5 - oh / 2
            sx, sy = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
            if 0 <= sx < w and 0 <= sy < h:
                sx, sy, v = sx - 0.5, sy - 0.5, 0.0
                for m in range(int(np.floor(sy)) - 1, int(np.floor(sy)) + 3):
                    for n in range(int(np.floor(sx)) - 1, int(np.floor(sx)) + 3):
                        v = v + kernel(sy - m) * kernel(sx - n) * x[min(max(m, 0), h - 1), min(max(n, 0), w - 1)]
                out[i, j] = np.clip(v, 0, 255)
    return out


@pytest.mark.parametrize(("degrees", "cubic", "grow"), [(5, False, False), (-12, False, False), (12, True, True), (90, True, True), (200, False, True), (47, True, False)])
def test_turned(degrees, cubic, grow):
    x = np.random.default_rng(1).integers(0, 256, (17, 23, 3)).astype(np.float32)
    got, want = images.turned(x, degrees, cubic, grow), turned_by_loops(x, degrees, cubic, grow)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-3
    if degrees == 90:
        assert np.allclose(got, np.rot90(x), atol=1e-3)


def test_positions_of_the_diagnostic():
    x = np.full((40, 60, 3), 100, np.float32)
    found = images.rotations(x)
    assert list(found) == [r[0] for r in images.ROTATIONS] and len(found) == 6
    assert np.array_equal(found["baseline_0deg"], x)
    assert [v.shape == x.shape for v in found.values()] == [True] * 5 + [False]
    grown = found["s48_original_plus12deg"]
    assert grown.shape == (52, 68, 3) and (grown[0, 0] == 255).all() and abs((grown == 100).all(2).sum() - 2400) < 100


def test_hues_agree_with_colorsys():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(0, 256, (60, 3)), [[0, 0, 0], [255, 255, 255], [9, 9, 9], [255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 0], [10, 200, 200]]])[None].astype(np.float32)
    for turn in (0.0, 0.02, -0.04, 0.5, 1.3):
        got = images.hue_turned(x, turn)
        for pixel, new in zip(x[0], got[0]):
            h, s, v = colorsys.rgb_to_hsv(*(float(c) / 255 for c in pixel))
            assert np.allclose(new / 255, colorsys.hsv_to_rgb((h + turn) % 1, s, v), atol=1e-5)
            assert np.allclose(images.hsv(pixel)[1:], (s, v), atol=1e-6)


def test_augmentation_takes_its_steps_in_order(monkeypatch):
    x = np.random.default_rng(3).integers(0, 256, (20, 24, 3)).astype(np.float32)
    seen = []
    for name in ("cropped", "turned", "blended", "hue_turned"):
        monkeypatch.setattr(images, name, lambda *a, f=getattr(images, name), name=name: seen.append(name) or f(*a))
    y = images.Augmentation(crop=(0.85, 0.9)).apply(x, 1, "a")
    assert seen == ["cropped", "turned", "blended", "blended", "blended", "hue_turned"]
    assert np.isfinite(y).all() and y.min() >= 0 and y.max() <= 255.001 and 0.8 < y.shape[0] * y.shape[1] / 480 < 0.95


def test_rank_stability(spark):
    lists = {("q", "base"): "abc", ("q", "one"): "abc", ("q", "two"): "cxa", ("q", "three"): "xyz", ("r", "base"): "d", ("r", "one"): "d", ("s", "one"): "ab"}
    category = dict(zip("abcdxyz", "AABCADD"))
    rows = [(q, v, p, category[p], k) for (q, v), ps in lists.items() for k, p in enumerate(ps, 1)]
    df = spark.createDataFrame(rows, "query_id string, variant string, product_id string, category string, rank int")
    got = {(r.query_id, r.variant): tuple(r)[2:] for r in analysis.rank_stability(df, "base").collect()}
    assert got["q", "base"] == got["q", "one"] == (3, 3, True, 0.0, 1, True)
    assert got["q", "two"] == (3, 2, False, 2.0, 2, False) and got["q", "three"] == (3, 0, False, None, 1, True)
    assert got["r", "one"] == (1, 1, True, 0.0, 1, True) and got["r", "two"] == (1, 0, False, None, None, False)
    assert {q for q, _ in got} == {"q", "r"} and len(got) == 8


# --- containers


def jpeg(width, height, channels, before=b""):
    return b"\xff\xd8\xff\xe0\0\x04ab" + before + b"\xff\xff\xc0\0\x11\x08" + struct.pack(">HHB", height, width, channels) + b"rest"


def tiff(order, width, height, channels=None):
    entries = [(256, 3, width), (257, 4, height)] + ([(277, 3, channels)] if channels else [])
    body = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in entries)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, len(entries)) + body


CASES = [
    (jpeg(640, 480, 3), ("JPEG", 640, 480, 3)),
    (jpeg(5, 7, 1, b"\xff\xc4\0\x03x\xff\xd0"), ("JPEG", 5, 7, 1)),
    (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBB", 3, 4, 8, 3), ("PNG", 3, 4, 1)),
    (b"GIF87a" + struct.pack("<HH", 300, 2), ("GIF", 300, 2, 1)),
    (b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 9, -8, 1, 32), ("BMP", 9, 8, 4)),
    (b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 9, 8, 1, 24), ("BMP", 9, 8, 3)),
    (b"RIFF\0\0\0\0WEBPVP8X\n\0\0\0\0\0\0\0" + b"\x01\0\0\x02\0\0", ("WEBP", 2, 3, 3)),
    (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28), ("WEBP", 100, 50, 4)),
    (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 16, 17), ("WEBP", 16, 17, 3)),
    (tiff("<", 21, 22, 3), ("TIFF", 21, 22, 3)),
    (tiff(">", 21, 22), ("TIFF", 21, 22, 1)),
    (b"not a picture", (None, None, None, None)),
    (b"", (None, None, None, None)),
    (None, (None, None, None, None)),
]


def test_container_headers(spark):
    for content, want in CASES:
        assert containers.container(content) == want
        # Cut anywhere, or with noise behind its magic bytes, a head is no error.
        for n in range(len(content or b"")):
            assert containers.container(content[:n])[0] in (want[0], None)
            containers.container(content[:8] + os.urandom(n))
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CASES)], "path long, content binary")
    got = {r.path: tuple(r)[1:] for r in containers.containers(df).collect()}
    assert got == {k: (*w, len(c or b"")) for k, (c, w) in enumerate(CASES)}


def test_format_check_and_inspection(spark, tmp_path):
    x = np.random.default_rng(4).integers(0, 256, (40, 50, 3))
    png(tmp_path / "a.png", x)
    png(tmp_path / "b.jpg", x)
    (tmp_path / "c.jpg").write_bytes(jpeg(9, 9, 3))
    (tmp_path / "d.JPEG").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.suffix_fits, r.allowed) for r in containers.format_check(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("PNG", True, False), "b.jpg": ("PNG", False, False), "c.jpg": ("JPEG", True, True), "d.JPEG": (None, False, False)}
    assert containers.format_check(spark, str(tmp_path), most=2).count() == 2
    rows = {r.origin.rsplit("/", 1)[1]: r for r in containers.inspected(spark, str(tmp_path)).collect()}
    assert (rows["a.png"].format, rows["a.png"].verified, rows["a.png"].file_size) == ("PNG", True, (tmp_path / "a.png").stat().st_size)
    assert rows["b.jpg"].verified and not rows["c.jpg"].verified and rows["d.JPEG"].format is None and rows["d.JPEG"].reason == "decode_error"


# --- records and states


def test_records_over_splits(spark, tmp_path):
    r, want = random.Random(3), []
    for f in range(3):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as file:
            w = csv.writer(file, lineterminator="\n")
            w.writerow(["id", "text", "n"])
            for k in range(60):
                w.writerow([f"{f}-{k}", r.choice(["plain", 'with "quotes"', "two\nlines", 'a\n\n\nb, "x\n"y', "", "'\"'", " é "]), k])
                if k % 7 == 3:
                    file.write("\n")
        with open(tmp_path / f"f{f}.csv", newline="") as file:
            want += [(f"f{f}.csv", n, row["id"], row["text"], row["n"]) for n, row in enumerate(csv.DictReader(file), 2)]
    # With splits of some lines, and of some files.
    for size in ("300", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            got = [(x._file.rsplit("/", 1)[1], x._row, x.id, x.text or "", x.n) for x in records.read_csv(spark, str(tmp_path)).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(got) == sorted(want)


def test_an_error_names_file_and_row(spark, tmp_path):
    head = "image_id,image_path,group_id,category,category_id,split,source,note\n"
    line = lambda k, c: f'i{k},"x\n{k}.png",g1,Ring,{c},train,dataset1,"a ""b"""\n'
    (tmp_path / "one.csv").write_text(head + line(1, 4) + line(2, 4))
    (tmp_path / "two.csv").write_text(head + line(3, 4) + "\n" + line(4, 4))
    rows = io.read_manifest(spark, str(tmp_path)).collect()
    assert {r.image_id: (r.image_path, r.category_id, r.metadata) for r in rows} == {f"i{k}": (f"x\n{k}.png", 4, {"note": 'a "b"'}) for k in range(1, 5)}
    (tmp_path / "two.csv").write_text(head + line(3, 4) + "\n" + line(4, "four"))
    with pytest.raises(Exception, match=r"row 3 of \S*two.csv, image_id i4: four"):
        io.read_manifest(spark, str(tmp_path)).collect()
    (tmp_path / "three.csv").write_text("other\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        io.read_manifest(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        io.read_manifest(spark, str(tmp_path / "empty"))


def test_a_state_is_whole_at_any_moment(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state.json")
    io.write_state(spark, path, epoch=1, best=0.5)
    io.write_state(spark, path, epoch=2, best=0.25)
    assert io.read_state(spark, path) == {"epoch": 2, "best": 0.25}
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["state.json"]

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(io, "_replace", dies)
        with pytest.raises(KeyboardInterrupt):
            io.write_state(spark, path, epoch=3, best=0.1)
    assert io.read_state(spark, path) == {"epoch": 2, "best": 0.25}
    for text, match in (('{"version": 2, "state": {}}', "version 2"), ('{"epoch": 1}', "version None"), ("[1]", "version None"), ("{", "no state"), ("", "no state")):
        other = tmp_path / "other.json"
        other.write_text(text)
        with pytest.raises(ValueError, match=match):
            io.read_state(spark, str(other))


def test_reports_tell_what_they_leave_out(spark):
    df = spark.range(5)
    assert "2 more rows" in io.markdown(df, 3) and "2 more rows" in io.html(df, most=3)
    assert "more rows" not in io.markdown(df, 5) + io.html(df, most=5)


# --- products and encoders


def test_product_images(spark):
    rows = [(3, "p", "c.png"), (1, "p", "a.txt"), (2, "p", "b.JPG"), (4, "q", "d.gif"), (5, "r", "e.webp"), (6, " ", "f.png"), (7, "s", "g"), (8, None, "h.png")]
    gallery = spark.createDataFrame(rows, "image_id long, product_id string, image_path string")
    listing = spark.createDataFrame([(p,) for p in ("a.txt", "c.png", "d.gif", "d.gif", "f.png", "g", "h.png")], "path string")
    assert {tuple(r) for r in search.product_images(gallery, listing).collect()} == {("p", "c.png"), ("q", "d.gif")}
    everything = listing.union(spark.createDataFrame([("b.JPG",), ("e.webp",)], "path string"))
    assert {tuple(r) for r in search.product_images(gallery, everything).collect()} == {("p", "b.JPG"), ("q", "d.gif"), ("r", "e.webp")}


def test_pooled_hits_carry_category_and_paths(spark):
    rows = [("q", 2, 7, "Ring", "b", 0.9), ("q", 1, 7, "Ring!", "a", 0.9), ("q", 3, 8, "Pendant", "c", 0.95), ("q", 4, 9, "Ring", "d", 0.1)]
    hits = spark.createDataFrame(rows, "query_id string, image_id long, product_id long, category string, image_path string, similarity double")
    got = {r.product_id: r for r in search.pool_hits(hits, 2).collect()}
    assert set(got) == {7, 8} and got[8]["rank"] == 1
    assert (got[7].category, got[7].matched_image_ids, got[7].matched_image_paths) == ("Ring!", [1, 2], ["a", "b"])
    assert {r.product_id: r.matched_image_ids for r in search.pool_hits(hits, 2, most_matches=1).collect()} == {7: [1], 8: [3]}
    with pytest.raises(ValueError):
        search.pool_hits(hits, 0)
    with pytest.raises(Exception, match="finite"):
        search.pool_hits(hits.withColumn("similarity", F.lit(float("nan"))), 2).collect()


def test_a_worker_opens_a_head_once(spark, tmp_path):
    r = np.random.default_rng(6)
    weights, bias = r.normal(0, 1, (3, 5)), r.normal(0, 1, 3)
    head = encoders.ShippedHead(spark, weights, bias)
    vectors = r.normal(0, 1, (400, 5))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "image_id long, embedding array<double>").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {x.image_id: x.embedding for _ in range(2) for x in head.vectors(df, "image_id").collect()}

        def count(batches):
            for b in batches:
                head.model()
                yield b.assign(pid=os.getpid(), times=encoders.opened[head.name])[["pid", "times"]]

        seen = df.select("image_id").mapInPandas(count, "pid long, times long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = vectors @ weights.T + bias
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose([got[k] for k in range(400)], want)
    # Many batches and three plans, one load for each process.
    assert len(seen) > 30 and {x.times for x in seen} == {1}
    with pytest.raises(Exception, match="takes vectors of 5"):
        head.vectors(df.withColumn("embedding", F.slice("embedding", 1, 4)), "image_id").collect()
    for bad in ((np.zeros(3), None), (weights, np.zeros(2)), (np.full((2, 2), np.nan), None)):
        with pytest.raises(ValueError):
            encoders.write_head(str(tmp_path / "h.npz"), *bad)
    encoders.write_head(str(tmp_path / "h.npz"), weights, bias, 2)
    assert np.array_equal(encoders.ShippedHead.from_file(spark, str(tmp_path / "h.npz")).model()["weights"], weights)


def test_pooled_pixels():
    x = np.random.default_rng(7).normal(0, 1, (2, 3, 7, 7))
    y = encoders.pooled(x, 3).reshape(2, 3, 3, 3)
    cuts = [0, 2, 4, 7]
    for i in range(3):
        for j in range(3):
            assert np.allclose(y[:, :, i, j], x[:, :, cuts[i] : cuts[i + 1], cuts[j] : cuts[j + 1]].mean((2, 3)))


def test_from_files_to_hits_in_one_plan(spark, tmp_path):
    r = np.random.default_rng(8)
    for k in range(4):
        png(tmp_path / f"{k}.png", r.integers(0, 256, (48, 64, 3)))
    loaded = images.read_images(spark, str(tmp_path))
    head = encoders.ShippedHead(spark, r.normal(0, 1, (6, 12)), grid=2)
    encoded = images.encode(loaded, head, 32).collect()
    name = lambda o: int(o.rsplit("/", 1)[1].split(".")[0])
    gallery = spark.createDataFrame([(name(e.origin), name(e.origin) // 2, ("Ring", "Pendant")[name(e.origin) // 2], e.embedding) for e in encoded], "image_id long, product_id long, category string, embedding array<double>")
    hits = images.search_top_images(loaded, gallery, head, 2, 32).collect()
    assert {(name(h.origin), h.image_id) for h in hits if h["rank"] == 1} == {(k, k) for k in range(4)} and len(hits) == 8
    own = loaded.withColumn("own", F.regexp_extract("origin", r"(\d+)\.png$", 1))
    hits = images.search_top_images(own, gallery, head, 3, 32, exclude="own").collect()
    assert len(hits) == 12 and all(name(h.origin) != h.image_id for h in hits)
    found = {(name(x.query_id), x.variant): x for x in images.rotation_diagnostic(loaded, gallery, head, 2, 32).collect()}
    assert len(found) == 24 and all(found[k, "baseline_0deg"].same_first and found[k, "baseline_0deg"].moved == 0 for k in range(4))
    with pytest.raises(ValueError):
        images.rotation_diagnostic(loaded, gallery, head, 51)
