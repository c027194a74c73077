"""Pair datasets, audits, samples, protocols, pixels and files that tables of numbers don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import analysis, audit, dedup, images, manifest, order, pairs, sampling, search
from lumenlake.plans import benchmark, experiments
from lumenlake.sources import io

from .test_operators import png

CATEGORIES = ("Bracelet", "Earrings", "Necklace", "Pendant", "Ring")


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for g in range(60):
        for k in range(1 + g % 4):
            split = "train" if g % 6 < 4 else "valid" if g % 6 == 4 else "test"
            rows.append((g * 10 + k, f"images/{split}/{g * 10 + k}.png", g, CATEGORIES[g % 5], g % 5, split, "dataset1"))
    return spark.createDataFrame(rows, "image_id long, image_path string, group_id long, category string, category_id long, split string, source string")


def test_places_and_running_sums_need_no_single_task(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.lit(1).alias("n")).repartition(7)
    got = order.numbered(rows, [F.col("x")], "place").collect()
    assert len(got) == 500 and all(r.x == r.place for r in got)
    got = order.running(rows, "x", ["n"], 40.0).collect()
    assert all(r.upto_n == r.x + 1 and r.all_n == 500 for r in got)


def test_search_blocks_of_both_sides_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(7)
    v = np.round(r.normal(0, 1, (60, 4)), 1)
    v[10], v[11] = v[9], v[9]
    g = spark.createDataFrame([(k, k % 13, "Ring", "train", v[k].tolist()) for k in range(60)], "image_id long, product_id long, category string, split string, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    want = {(q, k + 1): i for q in range(60) for k, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-round(s[q, i], 12), i))[:5])}
    for size in (1 << 24, 400):
        monkeypatch.setattr(search, "BLOCK_BYTES", size)
        monkeypatch.setattr(search, "TILE", 7)
        got = {(x.query_id, x.rank): x for x in search.top_images(search.as_queries(g), g, 5).collect()}
        assert len(got) == 300 and all(abs(x.similarity - s[q, want[q, k]]) < 1e-9 for (q, k), x in got.items())
        assert all(x.image_id == want[q, k] or abs(s[q, x.image_id] - s[q, want[q, k]]) < 1e-9 for (q, k), x in got.items())
    hits = search.top_images(search.as_queries(g), g, 12)
    assert search.in_top_k(hits, 12).count() == hits.count()
    with pytest.raises(ValueError, match="pooling"):
        search.pooled(hits, "median")
    with pytest.raises(Exception, match="distinct products"):
        search.rank_valid_products(hits).collect()
    assert search.rank_valid_products(search.pooled(hits).drop("rank")).count() > 0


def test_near_classes_join_on_sets_of_bands(spark):
    r = np.random.default_rng(2)
    base = r.integers(-(2**63), 2**63 - 1, 40).tolist()
    values = [*base, *base[:5]]
    for b in base[:20]:
        x = b
        for bit in r.choice(63, int(r.integers(1, 8)), replace=False):
            x ^= 1 << int(bit)
        values.append(x)
    rows = spark.createDataFrame([(k, "ab"[k % 2], f"{v}-{k % 3}", v) for k, v in enumerate(values)], "doc_id long, dataset string, exact_hash string, fp long")
    mask = (1 << 64) - 1
    far = lambda a, b: bin((a ^ b) & mask).count("1")
    want = {(i, j, far(a, b)) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and 1 <= far(a, b) <= 5}
    links, classes = dedup.near_classes(rows)
    one = rows.withColumn("dataset", F.lit("a"))
    assert {(r.doc_id_1, r.doc_id_2, r.distance) for r in dedup.near_pairs(one).collect()} == want
    assert links.agg(F.sum(F.col("files_1") * F.col("files_2"))).first()[0] == len(want) and classes.agg(F.sum("files")).first()[0] == len(values)
    for equal in (1, 2, 3, 4):
        assert sum(w for _, w in dedup.band_layout(5, 64, equal)) == 64
    across = {x for x in want if (x[0] - x[1]) % 2}
    assert {(r.doc_id_1, r.doc_id_2, r.distance) for r in dedup.near_pairs(rows, across=True).collect()} == across
    assert {(r.doc_id_1, r.doc_id_2, r.distance) for r in dedup.near_pairs(rows).collect()} == want - across


def test_pair_datasets(spark, table):
    for bad in ({"seed": -1}, {"seed": True}, {"ratio": -0.1}, {"ratio": float("nan")}, {"same_ratio": 1.2}, {"max_positives": 0}, {"max_negatives": 1.5}, {"splits": ()}, {"splits": ("dev",)}):
        with pytest.raises(ValueError):
            pairs.Config(**bad)
    config = pairs.Config(ratio=2.0, same_ratio=0.25, splits=("train",))
    p = pairs.dataset(table, config)
    report = {r.split: r for r in pairs.dataset_report(p, table, config).collect()}
    n = report["train"].positives
    assert report["train"].negatives == 2 * n and report["train"].same_category == round(2 * n * 0.25) and report[None].realised_ratio == 2.0 and n == report["train"].available
    assert pairs.violations(p, table).count() == 0
    assert sorted(map(str, p.collect())) == sorted(map(str, pairs.dataset(table.repartition(5), config).collect()))
    capped = pairs.dataset(table, pairs.Config(max_positives=7, max_negatives=3, splits=("train",)))
    assert capped.where("label = 1").count() == 7 and capped.where("label = 0").count() == 3
    with pytest.raises(ValueError, match="lacks the splits"):
        pairs.dataset(table.where("split <> 'test'"))
    first = pairs.negatives(table.where("split = 'train'"), "random", 20)
    other = pairs.negatives(table.where("split = 'train'"), "random", 20, occupied=first)
    assert other.join(first, ["image_id_1", "image_id_2"]).count() == 0
    rows = {r.model: r for r in experiments.gate_report(experiments.gate_pairs(table, ratio=0.5), table).collect()}
    assert set(rows) == {"hybrid", "random", "same_category", "cross_category"} and all(r.violations == 0 and r.other_groups == 0 for r in rows.values())


def test_selections(spark, table):
    p = pairs.dataset(table, pairs.Config(splits=("train",)))
    counts = {"train_groups": 5, "valid": 4, "test": 900, "positives": 3, "negatives": 7, "augmentation": 2}
    chosen = sampling.selection(table, p, counts)
    kinds = {r.kind: r["count"] for r in chosen.groupBy("kind").count().collect()}
    assert kinds["test"] == table.where("split = 'test'").count() and kinds["same_category"] == 3 and kinds["cross_category"] == 4 and kinds["augmentation"] == 2
    assert sampling.selection_violations(chosen, table, p).count() == 0
    groups = sampling.train_groups(table, 6).groupBy("group_id", "size").count().collect()
    assert len(groups) == 6 and sorted(r["size"] for r in groups) == [1, 1, 2, 2, 3, 3]
    few = p.where("negative_type = 'cross_category' or label = 1")
    assert sampling.balanced_negatives(few, 6).where("negative_type = 'cross_category'").count() == 6
    with pytest.raises(ValueError):
        sampling.take(table, "image_id", -1, 1)
    failures = spark.createDataFrame([(k, "Ring", "no_relevant_in_top10") for k in range(4)], "query_id long, query_category string, class string")
    assert sampling.failure_sample(failures, 4).count() == 4
    with pytest.raises(Exception, match="only 4 eligible"):
        sampling.failure_sample(failures, 5).collect()


def test_audits_and_protocols(spark, table):
    listing = table.select("image_path")
    found = {r.requirement: r.status for r in audit.cleaning_audit(table.withColumn("image_path", F.regexp_replace("image_path", "png$", "jpg")), listing).collect()}
    assert found["row_contract"] == "PASS" and found["no_missing_files"] == "FAIL" and found["no_corrupted_images"] == "NOT_AVAILABLE" and found["source_formats"] == "PASS"
    assert audit.overall(audit.cleaning_audit(table, listing)).first().status == "FAIL"
    with pytest.raises(ValueError, match="audit"):
        audit.cleaning_audit(table, mode="delete")
    assert {r.field for r in audit.metadata_policy(table.drop("source", "split")).where("not present").collect()} == {"source", "split"}
    with pytest.raises(ValueError, match="no rows"):
        manifest.of_split(table.where("split <> 'test'"), "test")
    with pytest.raises(ValueError, match="unknown"):
        manifest.of_split(table, "dev")
    assert manifest.of_split(table, "train", "Ring").count() > 0
    with pytest.raises(ValueError, match="protocol"):
        audit.assert_none(audit.protocol_violations(spark.createDataFrame([("test", "train")], "query_split string, gallery_split string")), "protocol")
    audit.assert_none(audit.metric_violations(spark.createDataFrame([("a", 0.0, 1.0)], "model string, top1 double, mrr double"), ["model"]), "metrics")
    epochs = spark.createDataFrame([(1, k, v) for k, v in enumerate([3.0, 2.9, 2.5, 2.45, 2.44, 2.0])], "run long, epoch long, val_loss double")
    got = [(r.best, r.bad_epochs, r.stop) for r in analysis.early_stopping_within(epochs, 2, 0.2).orderBy("epoch").collect()]
    assert got == [(3.0, 0, False), (3.0, 1, False), (2.5, 0, False), (2.5, 1, False), (2.5, 2, True), (2.0, 0, False)]
    for bad in ({"patience": 0}, {"patience": 1, "min_delta": -1}, {"patience": 1, "mode": "up"}):
        with pytest.raises(ValueError):
            analysis.early_stopping_within(epochs, **bad)
    a, b = (spark.createDataFrame([(k,) for k in ks], "query_id long") for ks in ((1, 2, 2), (2, 3)))
    assert {tuple(r) for r in analysis.set_mismatches(a, b, ["query_id"]).collect()} == {(1, "left"), (3, "right")}


def test_pixels(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.integers(0, 255, (60, 80, 3)).astype(np.float32)
    v = images.variants(x)
    assert set(v) == {"original", "rotation", "brightness", "center_crop", "resize"} and v["center_crop"].shape == (54, 72, 3) and v["resize"].shape == (32, 40, 3)
    assert np.allclose(images.rotated(x, 0), x) and np.allclose(images.rotated(images.rotated(x, 90)[:60, 10:70], -90)[20:40, 20:40], x[20:40, 30:50], atol=1e-2)
    assert np.allclose(v["brightness"], np.minimum(x * 1.2, 255), atol=1e-3)
    some = images.Augmentation(crop=(0.85, 1.0))
    assert np.array_equal(some.apply(x, 1, "a"), some.apply(x, 1, "a")) and not np.array_equal(some.apply(x, 1, "b")[:10, :10], some.apply(x, 1, "a")[:10, :10])
    assert np.array_equal(images.Augmentation(0, 0, 0, 0, 0, 0).apply(x, 1, "a"), x)
    for bad in ({"flip": 2}, {"degrees": 16}, {"contrast": -0.1}, {"crop": (0.9, 0.5)}, {"crop": (0.8, 1.0)}, {"ratio": (0.8, 1.0)}, {"hue": 0.05}, {"brightness": float("nan")}, {"saturation": True}):
        with pytest.raises(ValueError):
            images.Augmentation(**bad)
    folder = tmp_path / "q"
    folder.mkdir()
    png(folder / "one.png", x)
    loaded = images.read_images(spark, str(folder))
    encoder = lambda b: b.mean((2, 3))
    e = images.encode_variants(loaded, encoder, 16).collect()
    assert {r.variant for r in e} == set(v) and all(len(r.embedding) == 3 for r in e)
    assert images.encode_augmented(loaded, encoder, some, size=16).count() == 1
    with pytest.raises(ValueError, match="training"):
        images.encode_augmented(loaded, encoder, some, role="test")
    own = next(r.embedding for r in e if r.variant == "original")
    g = spark.createDataFrame([(1, 10, "Ring", own), (2, 20, "Ring", [-a for a in own])], "image_id long, product_id long, category string, embedding array<double>")
    found = images.answer(loaded, g, encoder, 2, 16)
    assert [r["product_id"] for r in found] == [10, 20] and found[0]["similarity_score"] == pytest.approx(100)
    for code, status, args in (("MODEL_UNAVAILABLE", 503, (loaded, g, None)), ("GALLERY_UNAVAILABLE", 503, (loaded, g.where("false"), encoder)), ("MISSING_FILE", 400, (loaded.where("false"), g, encoder))):
        with pytest.raises(images.QueryError) as error:
            images.answer(*args)
        assert (error.value.code, error.value.status) == (code, status)
    png(folder / "tiny.png", x[:8, :8])
    (folder / "bad.png").write_bytes(b"no image")
    for name in ("tiny", "bad"):
        with pytest.raises(images.QueryError, match="INVALID_IMAGE"):
            images.answer(images.read_images(spark, str(folder / f"{name}.png")), g, encoder)
    q = {r.origin.rsplit("/", 1)[1]: r for r in images.quality(images.read_images(spark, str(folder))).collect()}
    assert q["bad.png"].reason == "decode_error" and not q["bad.png"].readable and q["one.png"].mode == "RGB" and q["one.png"].aspect_ratio == 1.3333 and q["one.png"].total_pixels == 4800


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("image_id,image_path,group_id,category,split\ni1,x.png,g1,Ring,train\n")
    assert io.read_evaluation_manifest(spark, str(tmp_path / "e.csv")).columns == ["image_id", "image_path", "group_id", "category", "split"]
    head = "annotation_id,query_index,query_image_id,query_category,query_image_path,rank,product_id,candidate_category,similarity,candidate_image_id,candidate_image_path,relevance,notes\n"
    line = lambda k, label: f"a{k},1,q1,Ring,q.png,{k},p{k},Ring,0.5,c{k},c.png,{label},\n"
    (tmp_path / "a.csv").write_text(head + "".join(line(k, k % 4) for k in range(1, 11)))
    assert io.read_complete_annotations(spark, str(tmp_path / "a.csv")).count() == 10
    (tmp_path / "b.csv").write_text(head + "".join(line(k, 7) for k in range(1, 10)))
    with pytest.raises(ValueError, match="whole"):
        io.read_complete_annotations(spark, str(tmp_path / "b.csv"))
    io.write_state(spark, str(tmp_path / "state"), epoch=3, best=0.25, bad_epochs=1)
    assert io.read_state(spark, str(tmp_path / "state")) == {"epoch": 3, "best": 0.25, "bad_epochs": 1}
    (tmp_path / "r.json").write_text('{"model": "m", "results": [{"k": 1}, {"k": 2}]}')
    assert io.read_json(spark, str(tmp_path / "r.json")).select(F.explode("results")).count() == 2
    (tmp_path / "bad.json").write_text('{"model": ')
    with pytest.raises(Exception):
        io.read_json(spark, str(tmp_path / "bad.json"), "model string").collect()
    page = io.html(spark.createDataFrame([("<b>", 1)], "name string, n int"), "a & b")
    assert "&lt;b&gt;" in page and "<th>name</th>" in page and "a &amp; b" in page
    (tmp_path / "c.csv").write_text("image_id,image_path,group_id,category,category_id,split,source\ni1,x.png,g1,Ring,4,train,dataset1\ni2,y.png,g1,Ring,four,train,dataset1\n")
    with pytest.raises(Exception, match="row 3 of .*c.csv, image_id i2: four"):
        io.read_manifest(spark, str(tmp_path / "c.csv")).collect()


def test_timing(spark):
    assert benchmark.capped(100, 32, 2, 10) == (2, 2) and benchmark.capped(1000, 10, 5, 20) == (5, 20) and benchmark.capped(3, 10, 1, 1) == (0, 1)
    with pytest.raises(ValueError):
        benchmark.capped(0, 1, 0, 1)
    times = benchmark.timed(spark, {"a": lambda: spark.range(10), "b": lambda: spark.range(20)}, 1, 3)
    stats, best = benchmark.report(times)
    assert times.count() == 6 and {r.setting: r.n for r in stats.collect()} == {"a": 3, "b": 3} and best.first().setting in ("a", "b")
    rows = spark.createDataFrame([("Ring", k) for k in range(3)] + [("Pendant", 9)], "category string, k long")
    assert pairs.stratified_sample(rows, "k", "category", 1, whole=True).count() == 2
    with pytest.raises(ValueError, match="fewer than 2"):
        pairs.stratified_sample(rows, "k", "category", 2, whole=True)
