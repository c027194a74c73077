"""Literal cases for the retrieval, evaluation, pair and duplicate operators."""

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import vectors
from lumenlake.operators import analysis, dedup, evaluation, geometry, manifest, pairs, search


def gallery(spark, rows):
    return spark.createDataFrame(rows, "image_id long, product_id long, category string, split string, embedding array<double>")


@pytest.fixture
def small(spark):
    return gallery(spark, [(1, 10, "Ring", "train", [1.0, 0.0]), (2, 10, "Ring", "train", [0.99, 0.1]), (3, 20, "Necklace", "train", [0.7, 0.7]), (4, 30, "Bracelet", "train", [0.0, 1.0])])


def ask(spark, vector, query_id=99):
    return spark.createDataFrame([(query_id, vector)], "query_id long, embedding array<double>")


def test_products_are_ranked_by_their_best_image(spark, small):
    rows = search.search(ask(spark, [1.0, 0.0]), small, 2).orderBy("rank").collect()
    assert [r.product_id for r in rows] == [10, 20]
    assert rows[0].matched_image_ids == [1, 2] and rows[0].similarity == pytest.approx(1) and rows[0].similarity_score == pytest.approx(100)
    assert search.search(ask(spark, [1.0, 0.0]), small, 99).count() == 3


def test_an_excluded_image_is_absent(spark, small):
    q = search.as_queries(small).where("query_id = 1")
    rows = search.with_matches(search.top_products(q, small, 3), q, small).orderBy("rank").collect()
    assert rows[0].product_id == 10 and rows[0].matched_image_ids == [2]


def test_ties_go_to_the_smaller_id(spark):
    g = gallery(spark, [(k, 100 - k, "Ring", "train", [1.0, 0.0]) for k in (3, 1, 2)])
    assert [r.image_id for r in search.top_images(ask(spark, [2.0, 0.0]), g, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.product_id for r in search.top_products(ask(spark, [2.0, 0.0]), g, 2).orderBy("rank").collect()] == [97, 98]


def test_zero_vectors_and_empty_galleries(spark, small):
    assert [r.similarity for r in search.top_images(ask(spark, [0.0, 0.0]), small, 2).collect()] == [0.0, 0.0]
    assert search.top_images(ask(spark, [1.0, 0.0]), small.where("false"), 2).count() == 0
    with pytest.raises(ValueError):
        search.top_images(ask(spark, [1.0, 0.0]), small, 0)


def test_blocks_of_the_gallery_merge(spark, small, monkeypatch):
    q = search.as_queries(small)
    whole = sorted(map(tuple, search.top_products(q, small, 2).collect()))
    monkeypatch.setattr(search, "BLOCK_BYTES", 16)
    parts = sorted(map(tuple, search.top_products(q, small, 2).collect()))
    assert [(r[0], r[1], r[3]) for r in whole] == [(r[0], r[1], r[3]) for r in parts]


def test_leave_one_out_excludes_single_images(spark):
    g = gallery(spark, [(1, 1, "Ring", "train", [1.0, 0.0]), (2, 1, "Ring", "train", [0.99, 0.01]), (3, 2, "Bracelet", "train", [0.0, 1.0]), (4, 2, "Bracelet", "train", [0.01, 0.99]), (5, 3, "Ring", "train", [0.5, 0.5])])
    r = evaluation.means(evaluation.loo_products(g), []).first()
    assert (r.valid_queries, r.hit1, r.hit5) == (4, 1.0, 1.0)
    nn = evaluation.nearest_neighbour_accuracy(g).first()
    assert nn.queries == 5 and nn.correct == 4


def test_ranked_booleans(spark):
    cases = {1: [True, True, False, False, False], 2: [False] * 5, 3: [False, False, True, False, False]}
    ranking = spark.createDataFrame([(q, k + 1, b) for q, v in cases.items() for k, b in enumerate(v)], "query_id long, rank int, is_positive boolean")
    totals = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "query_id long, n_positive int")
    r = {x.query_id: x for x in evaluation.ranked_metrics(ranking, totals).collect()}
    assert (r[1].hit1, r[1].precision1, r[1].precision5, r[1].recall1, r[1].recall5, r[1].rr) == (1, 1, 0.4, 0.5, 1, 1)
    assert r[2].first_rank is None and r[2].rr == 0 and r[2].hit10 == 0
    assert r[3].rr == pytest.approx(1 / 3) and (r[3].hit1, r[3].hit5) == (0, 1)


def test_scores(spark):
    row = spark.createDataFrame([(-1.0, 0.0, 2.0)], "a double, b double, c double")
    s = row.select(vectors.score_from_similarity(F.col("a")), vectors.score_from_similarity(F.col("b")), vectors.score_from_distance(F.col("c"))).first()
    assert list(s) == [0, 50, 0]
    with pytest.raises(Exception, match="out of range"):
        row.select(vectors.score_from_similarity(F.col("c"))).collect()


def test_geometry_of_separable_pairs(spark):
    p = spark.createDataFrame([(1, 0.1, None), (1, 0.2, None), (0, 0.8, "cross_category"), (0, 0.9, "cross_category")], "label int, distance double, negative_type string")
    assert geometry.roc_auc(p).first()[0] == 1 and geometry.average_precision(p).first()[0] == 1
    assert geometry.best_threshold(p).first().accuracy == 1 and geometry.equal_error_rate(p).first().eer == 0
    assert geometry.subtype_stats(p, ("same_category", "cross_category")).orderBy("negative_type").collect()[1].n == 0


def manifest_of(spark, groups):
    rows = [(g * 10 + k, f"images/{g}/{k}.png", g, c, i, s, "dataset1") for g, (n, c, i, s) in groups.items() for k in range(n)]
    return spark.createDataFrame(rows, "image_id long, image_path string, group_id long, category string, category_id long, split string, source string")


def test_pairs(spark):
    m = manifest_of(spark, {1: (3, "Ring", 4, "train"), 2: (2, "Ring", 4, "train"), 3: (1, "Pendant", 3, "train"), 4: (2, "Pendant", 3, "train")})
    p = pairs.positives(m)
    assert p.count() == 5 == pairs.available_positives(m).first().available
    h = pairs.hybrid(m, "train")
    assert h.where("label = 0").count() == 5 and h.where("negative_type = 'same_category'").count() == 2
    assert pairs.violations(h, m).count() == 0
    assert sorted(map(tuple, h.select("pair_id").collect())) == sorted(map(tuple, pairs.hybrid(m.repartition(3), "train").select("pair_id").collect()))
    bad = h.withColumn("label", 1 - F.col("label"))
    with pytest.raises(ValueError):
        pairs.assert_valid(bad, m)
    folds = pairs.label_holdout(h).groupBy("label", "fold").count().collect()
    assert {(r.label, r.fold): r["count"] for r in folds} == {(0, "valid"): 1, (0, "train"): 4, (1, "valid"): 1, (1, "train"): 4}
    with pytest.raises(ValueError):
        pairs.group_holdout(m)


def test_manifest_rules(spark):
    m = manifest_of(spark, {1: (2, "Ring", 4, "train"), 2: (1, "Ring", 0, "dev")})
    assert {r.image_id: r.violations for r in manifest.row_violations(m).collect()} == {20: "category_id,unknown_split"}
    with pytest.raises(ValueError):
        manifest.check(m)
    assert manifest.split_leaks(m.withColumn("split", F.when(F.col("image_id") == 10, "valid").otherwise("train"))).first().splits == "train,valid"


def test_near_duplicates_by_bands_equal_brute_force(spark):
    values = [0, 1, 3, 31, 63, (1 << 40), (1 << 40) | 7, -1, -2]
    rows = spark.createDataFrame([(k, "a", str(k), v) for k, v in enumerate(values)], "doc_id long, dataset string, exact_hash string, fp long")
    found = {(r.doc_id_1, r.doc_id_2, r.distance) for r in dedup.near_pairs(rows, 5).collect()}
    mask = (1 << 64) - 1
    want = {(i, j, d) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and 1 <= (d := bin((a ^ b) & mask).count("1")) <= 5}
    assert found == want
    _, stats = dedup.limited_pairs(rows, 5, max_pairs=2)
    assert stats.first().status == "partial"
    assert sum(w for _, w in dedup.band_layout(5)) == 64


def test_relevance_and_failure_classes(spark):
    rows = [(1, "Ring", k + 1, r) for k, r in enumerate([3, 2, 1, 0, 0, 0, 0, 0, 0, 0])] + [(2, "Ring", k + 1, r) for k, r in enumerate([0] * 6 + [2, 0, 0, 0])]
    a = spark.createDataFrame(rows, "query_id long, query_category string, rank int, relevance int")
    r = {x.query_id: x for x in analysis.relevance(a).collect()}
    assert (r[1].hit1, r[1].precision5, r[1].relevance5, r[1].ndcg5) == (1, 0.4, 1.2, 1)
    assert r[2].ndcg5 == 0
    c = {x.query_id: x["class"] for x in analysis.failure_classes(a).collect()}
    assert c == {1: "relevant_at_top1_with_additional_top5_relevance", 2: "relevant_only_in_ranks_6_to_10"}
    assert analysis.annotation_violations(a).count() == 0 and analysis.annotation_violations(a.where("rank > 1")).count() == 2


def test_abnormal_reasons(spark):
    rows = spark.createDataFrame([(5.0, 2.0, 1.0, 0.0), (250.0, 3.0, 0.0, 1.0), (128.0, 4.0, 0.0, 0.0), (250.0, 12.0, 0.0, 1.0)], "m double, s double, d double, b double")
    found = [r[0] for r in rows.select(analysis.abnormal_reasons(F.col("m"), F.col("s"), F.col("d"), F.col("b"))).collect()]
    assert found == [["near_black"], ["near_white"], ["near_uniform"], []]


def test_model_choice(spark):
    r = spark.createDataFrame([("a", "valid", 0.5, 0.6, 0.1), ("b", "valid", 0.5, 0.7, 0.0)], "model string, split string, top1 double, top5 double, mrr double")
    assert analysis.select_model(r).first().model == "b"
    with pytest.raises(Exception, match="validation"):
        analysis.select_model(r.withColumn("split", F.lit("test"))).collect()
    c = analysis.compare_models(spark.createDataFrame([(0.0, 0.5)], "top1 double, mrr double"), spark.createDataFrame([(0.2, 0.4)], "top1 double, mrr double"))
    assert {x.metric: (x.relative, x.verdict) for x in c.collect()} == {"top1": (None, "improved"), "mrr": (-0.2, "regressed")}


def png(path, pixels):
    import struct
    import zlib

    import numpy as np

    h, w, c = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    import numpy as np

    from lumenlake.operators import images
    from lumenlake.sources import io

    (tmp_path / "a").mkdir()
    r = np.random.default_rng(1)
    noise = r.integers(0, 255, (40, 50, 3))
    for name, p in {"black": np.zeros((32, 32, 3)), "white": np.full((32, 32, 1), 255), "noise": noise, "clear": np.zeros((32, 32, 4))}.items():
        png(tmp_path / "a" / f"{name}.png", p)
    (tmp_path / "a" / "noise2.png").write_bytes((tmp_path / "a" / "noise.png").read_bytes())
    (tmp_path / "a" / "bad.png").write_bytes(b"not an image")
    loaded = images.read_images(spark, str(tmp_path))
    name = lambda o: o.rsplit("/", 1)[1].split(".")[0]
    q = {name(x.origin): x for x in images.quality(loaded).collect()}
    assert q["black"].reasons == ["near_black"] and q["white"].reasons == ["near_white"] and q["clear"].reasons == ["near_white"]
    assert q["noise"].status == "valid" and q["bad"].status == "invalid" and (q["noise"].width, q["noise"].height) == (50, 40)
    h = {name(x.origin): x.perceptual_hash for x in images.fingerprints(loaded).collect()}
    assert h["noise"] == h["noise2"] and h["bad"] is None
    e = images.encode(loaded, lambda x: x.mean((2, 3)), 16, 3).collect()
    assert len(e) == 5 and all(len(x.embedding) == 3 for x in e)
    files = io.content_hashes(io.list_images(spark, str(tmp_path), True))
    assert files.count() == 6 and files.select("exact_hash").distinct().count() == 5 and io.changed_files(files, files).count() == 0
    assert files.where("relative_path = 'a/black.png'").count() == 1


def test_manifest_files(spark, tmp_path):
    from lumenlake.sources import io

    (tmp_path / "m.csv").write_text("image_id,image_path,group_id,category,category_id,split,source,color\ni1, x.png ,g1,Ring,4,train,dataset1,red\ni2,/y.png,g1,Ring,4,train,dataset1,\n")
    rows = io.read_manifest(spark, str(tmp_path / "m.csv"), "/data").orderBy("image_id").collect()
    assert [x.image_path for x in rows] == ["/data/x.png", "/y.png"] and rows[0].metadata == {"color": "red"} and rows[1].metadata == {}
    (tmp_path / "bad.csv").write_text("image_id,image_path\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        io.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_streaming(spark, small, tmp_path):
    from lumenlake.streaming.serving import serve

    ask(spark, [1.0, 0.0]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, embedding array<double>").parquet(str(tmp_path / "in"))
    serve(stream, small, str(tmp_path / "out"), str(tmp_path / "c"), 2, once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
