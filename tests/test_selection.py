"""Selection by histograms, evaluation pairs, pruned search and duplicates by dataset, against plain Python."""

import hashlib
import random
from itertools import combinations, groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import cells, dedup, geometry, pairs, search, selection


@pytest.mark.parametrize("small", [10, 100_000])
def test_quantiles(spark, small):
    r = np.random.default_rng(1)
    values = np.concatenate([r.normal(0, 1, 5000), np.full(3000, 0.5), r.normal(0, 1, 50) * 1e300, [1e-320, -1.7e308, 1.7e308]])
    rows = [(("a", "b", None)[k % 3], float(v)) for k, v in enumerate(values)] + [("tiny", 1.0), ("tiny", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    points = [0, 0.25, 0.5, 0.75, 0.9, 0.999, 1]
    got = {x.g: x.quantiles for x in selection.quantiles(df, "v", points, "g", small=small).collect()}
    assert set(got) == {"a", "b", None, "tiny"}
    for g, found in got.items():
        assert np.allclose(found, np.quantile([v for k, v in rows if k == g and v is not None], points), rtol=1e-12)
    whole = selection.quantiles(df, "v", points, small=small).first().quantiles
    assert np.allclose(whole, np.quantile([v for _, v in rows if v is not None], points), rtol=1e-12)
    with pytest.raises(ValueError, match="finite"):
        selection.quantiles(spark.createDataFrame([(float("inf"),)], "v double"), "v", [0.5])


def test_groups_that_are_searched_in_turns(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_GROUPS", 2)
    monkeypatch.setattr(selection, "MOST_BINS", 16)
    df = spark.range(300).select((F.col("id") % 5).alias("g"), (F.col("id") * F.col("id") % 97).alias("v"))
    got = {x.g: x.quantiles for x in selection.quantiles(df, "v", [0.1, 0.5], "g", small=10).collect()}
    assert got == {g: pytest.approx(np.quantile([k * k % 97 for k in range(g, 300, 5)], [0.1, 0.5])) for g in range(5)}


def test_percentile_of_nothing(spark):
    df = spark.createDataFrame([(None,), (3.0,), (4.0,)], "v double")
    assert selection.percentile(df, "v", 50) == 3.5 and selection.percentile(df, "v", 100) == 4.0
    assert selection.percentile(df.where("v is null"), "v", 50, 0.0) == 0.0
    with pytest.raises(ValueError, match="empty"):
        selection.percentile(df.where("false"), "v", 50)
    with pytest.raises(ValueError, match="between"):
        selection.percentile(df, "v", 101)


@pytest.mark.parametrize("n", [0, 1, 700, 3000, 9000])
@pytest.mark.parametrize("kind", ["hash", "unique", "ties"])
def test_first_rows(spark, n, kind, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 50)
    key, bits = {"hash": (pairs.hash_int(1, F.col("id")), 60), "unique": (F.col("id"), 14), "ties": (F.col("id") % 7, 3)}[kind]
    df = spark.range(6000).withColumn("s", F.col("id") % 3)
    keyed = [(r.k, r.id, r.s) for r in df.withColumn("k", key).collect()]
    assert sorted(r.id for r in selection.first_n(df, key, n, [F.col("id")], bits).collect()) == sorted(i for _, i, _ in sorted(keyed)[:n])
    got = selection.first_by(df, key, {0: n, 2: n // 3}, "s", [F.col("id")], bits).collect()
    want = [i for s, m in ((0, n), (2, n // 3)) for _, i, _ in sorted(x for x in keyed if x[2] == s)[:m]]
    assert sorted(r.id for r in got) == sorted(want)


def manifest_of(spark, sizes, categories=3):
    rows = [(10 * g + k, g, f"c{g % categories}") for g, n in enumerate(sizes) for k in range(n)]
    return rows, spark.createDataFrame(rows, "image_id long, group_id long, category string")


def test_evaluation_pairs(spark):
    rows, m = manifest_of(spark, [3, 1, 2, 2, 4, 1, 2])
    for ratio, n in ((1.0, 12), (0.04, 1), (0.5, 6), (1.5, 18), (0.375, 4)):
        got = pairs.evaluation_pairs(m, ratio).collect()
        good, bad = ([r for r in got if r.label == x] for x in (1, 0))
        assert {(r.image_id_1, r.image_id_2) for r in good} == {(a, b) for (a, g, _), (b, h, _) in combinations(rows, 2) if g == h}
        assert len(bad) == len({r.pair_id for r in bad}) == n
        group, category = {i: g for i, g, _ in rows}, {i: c for i, _, c in rows}
        for r in bad:
            assert r.image_id_1 < r.image_id_2 and group[r.image_id_1] != group[r.image_id_2]
            assert r.negative_type == ("same_category" if category[r.image_id_1] == category[r.image_id_2] else "cross_category")
    again = pairs.evaluation_pairs(m.repartition(5), 0.375).collect()
    assert {r.pair_id for r in again} == {r.pair_id for r in got}
    for bad_ratio in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            pairs.evaluation_pairs(m, bad_ratio)
    with pytest.raises(ValueError, match="no positives"):
        pairs.evaluation_pairs(m.dropDuplicates(["group_id"]))
    with pytest.raises(ValueError, match="two groups"):
        pairs.evaluation_pairs(m.where("group_id = 0"))
    with pytest.raises(ValueError, match="fewer than"):
        pairs.evaluation_pairs(m, 50.0)


def test_negatives_are_the_first_of_all_draws(spark, monkeypatch):
    sizes = [40, 1, 40, 40] + [1] * 25 + [40, 40] + [1] * 4
    rows, m = manifest_of(spark, [0] * 3 + sizes)
    m = m.withColumn("image_id", 100 * F.col("group_id") + F.col("image_id") % 50).localCheckpoint()
    groups = sorted((g, sorted(i for _, i in own)) for g, own in groupby(sorted((r.group_id, r.image_id) for r in m.collect()), key=lambda x: x[0]))
    h = lambda k, slot: int(hashlib.md5(f"2026|{k}|{slot}".encode()).hexdigest()[:15], 16)
    want, k = {}, 0
    while len(want) < 3900:
        r = h(k, "pair") % (len(groups) * (len(groups) - 1) // 2)
        high = max(x for x in range(len(groups)) if x * (x - 1) // 2 <= r)
        a, b = groups[r - high * (high - 1) // 2][1], groups[high][1]
        want.setdefault(tuple(sorted((a[h(k, "a") % len(a)], b[h(k, "b") % len(b)]))), k)
        k += 1
    made = []
    cells_of_draws = cells.drawn_cells
    monkeypatch.setattr(cells, "drawn_cells", lambda *x: made.append(x) or cells_of_draws(*x))
    monkeypatch.setattr(pairs, "KNOWN", 1)
    got = pairs.evaluation_pairs(m).where("label = 0").select("image_id_1", "image_id_2").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    # Most draws are made without their numbers, and of lone groups only pairs that are new.
    (_, _, low, first, *_), (_, _, second, last, *_, rest) = made
    assert low == 0 and first == second < last < k and 0 < len(rest) < 435
    # More groups than a task should hold are joined.
    monkeypatch.setattr(pairs, "FEW", 1)
    got = pairs.evaluation_pairs(m).where("label = 0").select("image_id_1", "image_id_2").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(made) == 2


def test_unranking(spark):
    r = random.Random(1)
    ranks = list(range(60)) + [r.randrange(1 << 58) for _ in range(500)]
    ranks += [h * (h - 1) // 2 + d for h in (1 << 20, 94_906_267, 3 << 27) for d in (-1, 0, 1)]
    got = spark.createDataFrame([(x,) for x in ranks], "r long").select("r", pairs.unranked(F.col("r")).alias("u")).collect()
    for x in got:
        assert 0 <= x.u.low < x.u.high and x.u.high * (x.u.high - 1) // 2 + x.u.low == x.r
    assert len({tuple(x.u) for x in got}) == len(set(ranks))


def test_negatives_of_several_draws_are_those_of_each(spark):
    _, m = manifest_of(spark, [3, 1, 2, 2, 4, 1, 2, 5, 3, 2])
    draws = [pairs.Draw("same_category", 9, 5), pairs.Draw("cross_category", 20, 6), pairs.Draw("random", 15, 7)]
    got = pairs.drawn_negatives(m, draws).collect()
    for k, d in enumerate(draws):
        own = {(r.draw, r.pair_id, r.negative_type) for r in got if r.drawn == k}
        assert len(own) == d.n
        assert own == {(r.draw, r.pair_id, r.negative_type) for r in pairs.negatives(m, d.kind, d.n, d.seed).collect()}
    # Redraws only add later draws.
    short = pairs.negatives(m, "cross_category", 100, 6, factor=1)
    assert {r.pair_id for r in got if r.drawn == 1} == {r.pair_id for r in short.orderBy("draw").limit(20).collect()}


def test_geometry_report_is_one_table(spark):
    r = np.random.default_rng(2)
    rows = [(round(float(d), 2), int(r.random() < 1 - d)) for d in r.random(400)]
    df = spark.createDataFrame(rows, "distance double, label int")
    got = geometry.report(df).first().asDict()
    good, bad = [d for d, x in rows if x], [d for d, x in rows if not x]
    auc = np.mean([(a < b) + (a == b) / 2 for a in good for b in bad])
    assert got["positives"] == len(good) and got["roc_auc"] == pytest.approx(auc, abs=1e-6)
    assert got["positive_mean"] == pytest.approx(np.mean(good), abs=1e-6)
    for part, names in ((geometry.roc_auc, ["roc_auc"]), (geometry.average_precision, ["pr_auc"]), (geometry.best_threshold, ["threshold", "accuracy", "precision", "recall", "f1"])):
        assert [got[n] for n in names] == list(part(df).first())
    assert [got["eer"], got["eer_threshold"]] == list(geometry.equal_error_rate(df).first())


def gallery_of(spark, vectors, products):
    return spark.createDataFrame([(k, int(products[k]), [float(x) for x in v]) for k, v in enumerate(vectors)], "image_id long, product_id long, embedding array<double>").repartition(3)


def nearest(vectors, k):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    return {q: [(i, round(s[q, i], 9)) for i in np.lexsort((np.arange(len(s)), -np.round(s[q], 12)))[:k]] for q in range(len(s))}


def test_pruned_search_loses_nothing_and_skips_most(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (12, 16))
    vectors = np.concatenate([centres[k % 12] + r.normal(0, 0.03, 16) for k in range(360)]).reshape(360, 16)
    vectors[7] = vectors[19] = 0
    vectors[31] = vectors[43]
    products = np.arange(360) % 90
    g = gallery_of(spark, vectors, products)
    q = search.as_queries(g)
    whole, pruned = (search.top_images(q, g, 4, block_bytes=b).collect() for b in (1 << 24, 1 << 10))
    key = lambda rows: {(x.query_id, x["rank"]): (x.image_id, round(x.similarity, 9)) for x in rows}
    assert key(whole) == key(pruned)
    one, two = (search.top_products(q, g, 3, block_bytes=b).collect() for b in (1 << 24, 1 << 10))
    key = lambda rows: {(x.query_id, x["rank"]): (x.product_id, round(x.similarity, 9)) for x in rows}
    assert key(one) == key(two)
    counts = search.pruning(q, g, 4, block_bytes=1 << 10).first()
    assert counts.met + counts.skipped == counts.meetings and counts.skipped > 0.6 * counts.meetings


def test_pruned_search_of_spread_vectors_and_of_few(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(0, 1, (60, 4))
    g = gallery_of(spark, vectors, np.arange(60))
    got = search.top_images(search.as_queries(g), g, 5, block_bytes=256).collect()
    want = nearest(vectors, 5)
    assert {(x.query_id, x["rank"]): x.image_id for x in got} == {(q, k + 1): i for q, rows in want.items() for k, (i, _) in enumerate(rows)}
    # More than there are, and no queries at all.
    assert search.top_images(search.as_queries(g), g, 100, block_bytes=256).count() == 60 * 59
    assert search.top_images(search.as_queries(g).where("false"), g, 5, block_bytes=256).count() == 0


def test_duplicates_stay_within_their_dataset(spark):
    rows = [(1, "a", "x", 0), (2, "b", "x", 0), (3, "a", "x", 0), (4, "a", "y", 0), (5, "b", "z", 7), (6, "b", "u", 3), (7, "a", "w", 15)]
    df = spark.createDataFrame([(*r, f"{r[3]:064b}") for r in rows], "doc_id long, dataset string, exact_hash string, fp long, bits string")
    assert [tuple(r) for r in dedup.exact_groups(df).collect()] == [("a", "x", 2, "1,3")]
    assert [(r.dataset, r.files, r.contents, r.members) for r in dedup.perceptual_groups(df).collect()] == [("a", 3, 2, "1,3,4")]
    near = lambda across: {(a[0], b[0], bin(a[3] ^ b[3]).count("1")) for a, b in combinations(rows, 2) if (a[1] != b[1]) == across and 1 <= bin(a[3] ^ b[3]).count("1") <= 5}
    for across in (False, True):
        assert {tuple(r) for r in dedup.near_pairs(df, across=across).collect()} == near(across)
    s = dedup.summary(df).first()
    assert (s.files, s.files_a, s.files_b, s.unreadable, s.exact_groups, s.perceptual_groups) == (7, 4, 3, 0, 1, 1)
    assert (s.near_pairs, s.cross_near_pairs, s.cross_exact_groups, s.cross_perceptual_groups) == (len(near(False)), len(near(True)), 1, 1)


@pytest.mark.parametrize(("most", "limit"), [(None, None), (3, None), (2, 15), (None, 40)])
def test_limited_pairs(spark, most, limit):
    r = random.Random(5)
    rows = [(k, "ab"[k % 2], f"h{k % 9}", r.choice([0, 1, 3, (1 << 40) - 1, r.randrange(1 << 62)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, dataset string, exact_hash string, fp long").repartition(3)
    layout = dedup.band_layout(5)
    band = lambda x: [(x >> at) & ((1 << width) - 1) for at, width in layout]
    found = [(a, b) for a, b in combinations(rows, 2) if a[1] == b[1] and any(x == y for x, y in zip(band(a[3]), band(b[3])))]
    kept = [p for i in range(60) for p in [p for p in found if p[0][0] == i][:most]][:limit]
    near, stats = dedup.limited_pairs(df, 5, most, limit)
    assert tuple(stats.first()) == (len(found), len(kept), len(found) - len(kept), "partial" if len(found) > len(kept) else "complete")
    want = {(a[0], b[0]) for a, b in kept if a[2] != b[2] and 1 <= bin(a[3] ^ b[3]).count("1") <= 5}
    assert {(x.doc_id_1, x.doc_id_2) for x in near.collect()} == want


def test_visited_blocks_are_screened_by_the_bound(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(400, 16))
    ids, products, pivot = np.arange(400), np.arange(400) % 30, (np.arange(400) % 5).astype(np.int32)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    gallery = pa.table({"image_id": ids, "product_id": products, "pivot": pivot, "vector": lists(v)})
    sims = np.einsum("ij,kj->ik", unit, unit)
    np.fill_diagonal(sims, -2)
    # Some queries don't visit all clusters.
    clusters = [[c for c in range(5) if c != q % 7] for q in range(400)]
    for q, own in enumerate(clusters):
        sims[q, ~np.isin(pivot, own)] = -2
    for pooled in (False, True):
        best = np.stack([sims[:, products == p].max(1) for p in range(30)], 1) if pooled else sims
        least = np.sort(best, axis=1)[:, -3]
        asked = pa.table({"query_id": ids, "pivot": pivot, "least": least, "clusters": pa.array(clusters, pa.list_(pa.int32())), "asked": lists(v)})
        want = {(q, j) for q in range(400) for j in np.lexsort((np.arange(best.shape[1]), -best[q]))[:3].tolist()}
        key = "product_id" if pooled else "image_id"
        pairs_of = lambda t, key=key: set(zip(t["query_id"].to_pylist(), t[key].to_pylist()))
        # Left to double precision altogether, the same comes out.
        with monkeypatch.context() as m:
            m.setattr(search, "MOST_LEFT", -1, raising=False)
            assert pairs_of(search._meeting(3, pooled, True)(asked, gallery)) == want
        with monkeypatch.context() as m:
            m.setattr(search, "_best_of_rows", None)
            assert pairs_of(search._meeting(3, pooled, True)(asked, gallery)) == want
