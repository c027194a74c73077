"""Draws and distances as arrays."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lumenlake.functions import md5
from lumenlake.operators import geometry, packing, pairs


def test_md5_of_many_numbers():
    x = np.array([0, 9, 10, 99, 100, 123456, 10**12, 10**18])
    for slot in ("c1", "slot" * 20):
        assert md5.hashes(2026, x, slot).tolist() == [int(hashlib.md5(f"2026|{v}|{slot}".encode()).hexdigest()[:15], 16) for v in x]


def test_md5_of_many_pairs():
    names = [b"7", b"12", b"100", b"99999", b"ring", "M\u00fcnze".encode(), b"x" * 23, b"y" * 30]
    rank = np.array([3, 1, 2, 5, 4, 0, 6, 7])
    key = lambda i, j: int(hashlib.md5(b"2026|" + names[i] + b"__" + names[j]).hexdigest()[:15], 16)
    every = {(i, j): key(i, j) for i in range(8) for j in range(8) if rank[i] < rank[j]}
    for bound in (0, sorted(every.values())[9], 1 << 60):
        i, j = md5.pairs_below(2026, names, names, rank, rank, bound)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(p for p, h in every.items() if h < bound)


def test_first_pairs_are_made_without_the_others(spark):
    for cast in ("long", "string"):
        rows = spark.range(70).select(F.col("id").cast(cast).alias("image_id"), (F.col("id") % 3).alias("group_id"), F.when(F.col("id") % 5 > 0, "Ring").alias("category"), F.lit("train").alias("split"))
        rows = rows.unionByName(rows.limit(1).withColumn("group_id", F.lit(None).cast("long"))).unionByName(rows.where("image_id = '8'"))
        every = pairs.positives(rows)
        want = sorted(map(str, every.where(pairs.hash_int(5, F.col("pair_id")) < 1 << 57).collect()))
        below = pairs.hashed_below(rows, 5, 1 << 57, "split", "group_id", block=9)
        assert want == sorted(map(str, pairs._positive(below).collect())) and len(want) > 40
        first = pairs._first_positives(rows, 20, 5, every.count())
        assert sorted(map(str, first.collect())) == sorted(map(str, every.orderBy(pairs.hash_int(5, F.col("pair_id")), "pair_id").limit(20).collect()))
        # The pairs are hashed in blocks: no row of a join is made for each.
        plan = below._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "image_id_1 <" not in plan


def test_checks_shuffle_hashes_of_pairs(spark):
    m = spark.range(40).select(F.col("id").alias("image_id"), (F.col("id") % 4).alias("group_id"), F.lit("Ring").alias("category"), F.lit("train").alias("split"))
    p = pairs.positives(m)
    assert pairs.violations(p, m).count() == 0
    # No row is moved for a pair that isn't there twice.
    plan = pairs._with_times(p)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    twice = p.unionByName(p.where("image_id_1 = 1")).unionByName(p.where("image_id_1 = 2").withColumns({"image_id_1": F.col("image_id_2"), "image_id_2": F.lit(2).cast("long")}))
    got = {(r.image_id_1, r.image_id_2): r.violations for r in pairs.violations(twice, m).collect()}
    for x, y in ((1, 5), (2, 6)):
        assert got[(x, y)] == "repeated"
    assert got[(6, 2)] == "repeated,not_canonical" and len(got) == 27


def test_arrays_hold_all_rows_or_the_least(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK", 50)
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"), (1000 - F.col("id")).alias("draw"))
    every = packing.unpacked(packing.packed(rows, ["k"], ["v", "draw"]), ["k"], ["v", "draw"])
    assert sorted(every.collect()) == sorted(rows.collect())
    least = packing.unpacked(packing.packed(rows, ["k"], ["v", "draw"], least="draw"), ["k"], ["v", "draw"])
    best = lambda df: sorted(map(tuple, df.groupBy("k", "v").agg(F.min("draw")).collect()))
    assert best(least) == best(rows) and least.count() <= 400


def test_draws_are_made_once_where_most_groups_have_one_image():
    # Most draws name two groups of one image, which have few pairs.
    sizes = {1: 30, 40: 5}
    rnd, seen, draws = random.Random(1), set(), pairs._expected_draws(sizes, 1500, 10**6)
    n = [1] * 30 + [40] * 5
    for _ in range(draws):
        a, b = sorted(rnd.sample(range(35), 2))
        seen.add((a, b, rnd.randrange(n[a]), rnd.randrange(n[b])))
    assert draws > 3 * 1500 and 1500 <= len(seen) < 2200


def test_thresholds_are_not_shuffled_pair_by_pair(spark):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)] + [(1, None)]
    t = geometry.threshold_table(spark.createDataFrame(data, "label int, distance double"))
    got, tp, fp = t.orderBy(F.col("distance").asc_nulls_last()).collect(), 0, 0
    for r, d in zip(got, [*sorted({d for _, d in data[:-1]}), None], strict=True):
        own = [x for x, e in data if e == d]
        tp, fp = tp + sum(own), fp + len(own) - sum(own)
        assert (r.distance, r.p, r.n, r.tp, r.fp) == (d, sum(own), len(own) - sum(own), tp, fp)
        assert (r.positives, r.negatives) == (sum(x for x, _ in data), sum(1 - x for x, _ in data))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(distance" not in plan


def test_rising_numbers_take_a_byte_or_two():
    rnd = np.random.default_rng(4)
    for values in ([], [0], [5, 5, 127, 255, 1 << 14, (1 << 14) + 127, 1 << 40, 1 << 61]), np.sort(rnd.integers(0, 10**6, 5000)):
        for one in values if isinstance(values, tuple) else [values]:
            one = np.array(one, np.int64)
            assert packing.from_gaps(packing.gaps(one)).tolist() == one.tolist()
    assert len(packing.gaps(np.sort(rnd.integers(0, 10**6, 5000)))) < 2 * 5000
    values = np.array([3, 9, 9, 2, 500, 0, 0, 7])
    rows = packing.gaps_of(values, np.array([0, 3, 5]))
    assert packing.from_gaps_of(rows.to_pylist(), np.array([3, 2, 3])).tolist() == values.tolist()
    assert packing.from_gaps(rows[1].as_py()).tolist() == [2, 500]


def test_hashes_of_a_run_are_those_of_its_numbers():
    for which in (0, 1, 99, 12345678):
        for slot in ("pair", "slot" * 20):
            numbers = np.arange(which * md5.RUN, (which + 1) * md5.RUN)
            assert (md5.run(2026, which, slot) == md5.hashes(2026, numbers, slot)).all()


def test_distances_are_kept_in_a_byte_or_two(monkeypatch):
    rnd = np.random.default_rng(6)
    distance = np.concatenate([np.round(rnd.random(20000) / 100, 9), [np.nan, 0.5, 0.5, 1 / 3, 1 / 3, 1e300, np.inf, -0.25]])
    label = rnd.integers(0, 2, len(distance))
    coded = pa.Table.from_batches([geometry._code(label, distance)])
    assert sum(len(x) for x in coded["distances"].to_pylist()) < 2.5 * len(distance)
    want = {}
    for d, x in zip(distance.tolist(), label.tolist()):
        d = None if d != d else d
        p, n = want.get(d, (0, 0))
        want[d] = (p + x, n + 1 - x)
    for most in (geometry.DENSE, 100):
        monkeypatch.setattr(geometry, "DENSE", most)
        got, tp = {}, 0
        for at in sorted(set(coded["bin"].to_pylist()), key=lambda x: (x is None, x)):
            t = coded.filter(pc.is_null(coded["bin"]) if at is None else pc.equal(coded["bin"], at))
            for c, k in (("before_p", tp), ("before_n", 0), *((c, 0) for c in geometry.TOTALS)):
                t = t.append_column(c, pa.array([k] * len(t)))
            for r in geometry._counted(t).to_pylist():
                got[r["distance"]] = (r["p"], r["n"])
                tp += r["p"]
                assert r["tp"] == tp
        assert got == want


def test_statistics_of_labels_are_those_of_their_distances(spark):
    rnd = random.Random(8)
    data = [(k % 2, round(rnd.random() * 1.5, rnd.choice((1, 9)))) for k in range(301)] + [(0, None), (1, 1 / 3), (0, 1 / 3)]
    for some in (data, [x for x in data if x[0]], [(1, None)], [(0, 0.25)]):
        df = spark.createDataFrame(some, "label int, distance double")
        key = lambda rows: sorted((r.label, [None if x is None else round(x, 6) for x in r[1:]]) for r in rows)
        assert key(geometry.label_stats(df).collect()) == key(geometry.distance_stats(df, "label").collect())
